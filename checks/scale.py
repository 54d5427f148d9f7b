"""Time queries over replicated, skewed input: ``python checks/scale.py COPIES FOLDER [query ...]``.

Writes FOLDER/sfN once (events copied COPIES times, with a third of all rows given to one user, and
parts copied likewise) and reuses it afterwards.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks import catalog  # noqa: E402
from jobmeter.session import local_session  # noqa: E402

SOURCE = "/root/testdata/sf0.1"


def build(spark: SparkSession, copies: int, folder: str) -> None:
    offsets = spark.range(copies).withColumnRenamed("id", "copy")
    events = spark.read.parquet(f"{SOURCE}/events.parquet")
    user = F.when(F.col("event_id") % 3 == 1, 7).otherwise(F.col("user_id") + F.col("copy") * 1500)
    copied = offsets.repartition(copies, "copy").join(F.broadcast(events)).select(
        (F.col("event_id") + F.col("copy") * 1_000_000).alias("event_id"),
        (F.col("ts") + F.make_dt_interval(F.col("copy") % 365)).alias("ts"),
        user.cast("long").alias("user_id"), "event_type", "value", "props",
    )
    copied.write.parquet(f"{folder}/events.parquet")
    part = spark.read.parquet(f"{SOURCE}/part.parquet")
    offsets.repartition(copies, "copy").join(F.broadcast(part)).select(
        (F.col("p_partkey") + F.col("copy") * 1_000_000).alias("p_partkey"),
        *[c for c in part.columns if c != "p_partkey"],
    ).write.parquet(f"{folder}/part.parquet")


def main(argv: list[str]) -> None:
    copies, base = int(argv[0]), argv[1]
    names = argv[2:] or list(catalog.QUERIES)
    spark = local_session(8, partitions=32, memory="20g")
    folder = f"{base}/sf{copies}"
    if not Path(folder).exists():
        build(spark, copies, folder)
    for name in names:
        started = time.perf_counter()
        catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        print(f"{name:26s} {time.perf_counter() - started:7.2f}s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
