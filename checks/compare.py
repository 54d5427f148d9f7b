"""Run registered queries next to their SQL twins and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks import catalog, oracle  # noqa: E402
from checks.fixtures import TABLES  # noqa: E402
from jobmeter.session import local_session  # noqa: E402


TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def cell(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when schema names, types and rows agree, else a short report."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    for name, kind in spark_df.dtypes:
        if TYPES.get(kind) != types[name].split("(")[0]:
            return f"type of {name}: {kind} != {types[name]}"
    order = sorted(names)
    expected = Counter(
        tuple(cell(row[names.index(c)]) for c in order) for row in result.fetchall()
    )
    actual = Counter(tuple(cell(row[c]) for c in order) for row in spark_df.collect())
    if actual == expected:
        return None
    extra, lost = list((actual - expected).items())[:2], list((expected - actual).items())[:2]
    return f"rows {sum(actual.values())} vs {sum(expected.values())}; spark only {extra}; sql only {lost}"


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(catalog.QUERIES)
    spark, con, twins, failed = local_session(8), connect(sf_dir), oracle.oracle_sql(), 0
    for name in names:
        started = time.time()
        try:
            df = catalog.run(name, spark, sf_dir)
            report = difference(df, con, twins[name]) if name in twins else f"rows only: {df.count()}"
            bad = report is not None and name in twins
        except Exception as error:  # report and go on with the other queries
            report, bad = f"{type(error).__name__}: {str(error)[:700]}", True
        failed += bad
        print(f"{'BAD' if bad else 'ok '} {name:26s} {time.time() - started:6.2f}s {report or ''}", flush=True)
    print(f"{len(names)} queries, {failed} bad")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
