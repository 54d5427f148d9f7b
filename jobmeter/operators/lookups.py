"""Dictionary lookups: a checked broadcast, node zones, label codes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.constants import CATEGORICAL_COLUMNS, DEFAULT_ZONE, ZONE_BY_PREFIX
from jobmeter.operators.ranking import with_position

BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only if it is counted to be small.

    Beyond the bound it is returned as it is and Spark joins by shuffle, where adaptive execution
    splits hot keys of the other side.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def map_literal(entries: Mapping[str, object]) -> Column:
    """A driver-side dictionary as a map column."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def zone_lookup(
    df: DataFrame,
    prefix: str = "node_prefix",
    mapping: Mapping[str, str] | DataFrame | None = None,
    name: str = "zone",
) -> DataFrame:
    """Add the grid zone of a node prefix: exact match, then ignoring case, then the default zone.

    A dictionary becomes a map literal (no join at all); a table (prefix, zone) is joined.
    """
    key = F.when(F.col(prefix) != "", F.col(prefix))
    if isinstance(mapping, DataFrame):
        table = mapping.where(F.col("prefix").isNotNull()).groupBy("prefix").agg(
            F.min("zone").alias("_exact")
        )
        folded = table.groupBy(F.lower("prefix").alias("_folded")).agg(
            F.min_by("_exact", "prefix").alias("_any_case")
        )
        joined = (
            df.withColumn("_key", key)
            .join(small_side(table.withColumnRenamed("prefix", "_key")), "_key", "left")
            .withColumn("_folded", F.lower("_key"))
            .join(small_side(folded), "_folded", "left")
        )
        zone = F.coalesce("_exact", "_any_case", F.lit(DEFAULT_ZONE))
        return joined.withColumn(name, zone).drop("_key", "_folded", "_exact", "_any_case")
    entries = mapping or ZONE_BY_PREFIX
    folded_entries: dict[str, str] = {}
    for entry, zone_name in entries.items():
        folded_entries.setdefault(entry.lower(), zone_name)
    zone = F.coalesce(
        F.try_element_at(map_literal(entries), key),
        F.try_element_at(map_literal(folded_entries), F.lower(key)),
        F.lit(DEFAULT_ZONE),
    )
    return df.withColumn(name, zone)


def label_dictionary(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value, code): distinct known values of each column numbered in code-point order."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    values = df.select(F.inline(pairs)).where("value is not null").distinct()
    placed = with_position(values, [F.col("column"), F.col("value")])
    first = placed.groupBy("column").agg(F.min("position").alias("_first"))
    return placed.join(first, "column").select(
        "column", "value", (F.col("position") - F.col("_first")).cast("int").alias("code")
    )


def label_encode(df: DataFrame, columns: Iterable[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Replace the given text columns by their integer codes; null becomes -1, absent ones are skipped."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    dictionary = label_dictionary(df, present)
    # One count of all dictionaries (one row per column) tells which are small enough to broadcast.
    sizes = {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}
    order = df.columns
    for c in present:
        codes = dictionary.where(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        codes = F.broadcast(codes) if sizes.get(c, 0) <= BROADCAST_ROWS else codes
        df = (
            df.join(codes, F.col(c).cast("string") == F.col("_value"), "left")
            .withColumn(c, F.coalesce("_code", F.lit(-1)))
            .drop("_value", "_code")
        )
    return df.select(*order)
