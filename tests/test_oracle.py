"""Every registered query against its SQL twin."""

import pytest

from checks import catalog, oracle
from checks.compare import connect, difference
from tests.conftest import SF_DIR

TWINS = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(TWINS)



@pytest.mark.parametrize("name", sorted(TWINS))
def test_matches_sql(spark, con, name):
    assert difference(catalog.run(name, spark, SF_DIR), con, TWINS[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    table = entry.entry(spark)
    assert table.count() > 20
    assert {"start_day", "peakVolume", "efficiencyAnomaly"} <= set(table.columns)
    assert set(entry.queries()) >= set(catalog.QUERIES)
