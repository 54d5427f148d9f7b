"""Frequency tables, top-k reports and exact global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.session import checkpointed


def value_counts(df: DataFrame, column: str, share_digits: int | None = None) -> DataFrame:
    """Rows per non-null value of ``column`` with their share of *all* rows, most frequent first.

    Columns: ``column``, job_count, percentage, distinct_values.
    """
    return with_totals(df, column, share_digits).drop("all_rows", "known_rows")


def with_totals(df: DataFrame, column: str, share_digits: int | None = None) -> DataFrame:
    """``value_counts`` with the numbers of all rows and of rows with a known value."""
    counted = df.groupBy(column).agg(F.count("*").alias("job_count"), F.count(column).alias("known"))
    return with_shares(counted, column, share_digits, totals=True)


def with_shares(
    counted: DataFrame, column: str, share_digits: int | None = None, totals: bool = False
) -> DataFrame:
    """``value_counts`` from a table (column, job_count, known) that includes the null group.

    The totals come from the counted table, so the input is read once; null is filtered by its
    counter because a filter on the column itself would be pushed into only one of the two uses
    and cost a second scan.
    """
    sums = counted.agg(
        F.struct(
            F.sum("job_count").alias("all_rows"),
            F.sum("known").alias("known_rows"),
            F.count_if(F.col("known") > 0).alias("values"),
        ).alias("t")
    )
    percentage = F.col("job_count") * 100.0 / F.col("t.all_rows")
    if share_digits is not None:
        percentage = F.bround(F.col("job_count") / F.col("t.all_rows") * 100.0, share_digits)
    return (
        counted.where("known > 0")
        .withColumn("t", sums.scalar())
        .select(
            column,
            "job_count",
            percentage.alias("percentage"),
            F.col("t.values").alias("distinct_values"),
            *([F.col("t.all_rows"), F.col("t.known_rows")] if totals else []),
        )
        .orderBy(F.desc("job_count"), column)
    )


def top_k(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ties go to the smaller ``key``."""
    return df.orderBy(F.desc(by), key).limit(k)


def rank_codes(top: DataFrame, by: str, key: str, label: str) -> DataFrame:
    """Replace the ids of a top-k report by ``label n`` in rank order.

    The window has no partition because its input is a report of k rows.
    """
    position = F.row_number().over(W.orderBy(F.desc(by), key))
    return top.withColumn(key, F.concat(F.lit(f"{label} "), position.cast("string")))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Exact 0-based position of every row in a global order, without a one-task window.

    The table is range-partitioned and sorted by Spark and checkpointed, so that the partitions are
    fixed; a row's position is its partition's offset plus its place in the partition. Only one
    number per partition takes part in the offset step.
    """
    ordered = checkpointed(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_id"), 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return (
        ordered.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + place)
        .drop("_id", "_part", "_before", "_size")
    )
