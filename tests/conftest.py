import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from jobmeter.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=8)
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Evaluate a column function over texts: [(input, output), ...] in input order."""

    def run(function, texts, name="t"):
        from pyspark.sql import functions as F

        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, f"i int, {name} string").select(
            "i", function(F.col(name)).alias("out")
        )
        return [r["out"] for r in df.orderBy("i").collect()]

    return run
