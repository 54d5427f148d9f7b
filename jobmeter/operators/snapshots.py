"""What changed between exports of one table: differences of multisets, and validity of row versions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.operators.lookups import small_side
from jobmeter.session import materialize


def row_digest(columns: Iterable[str]) -> Column:
    """128 bits of hash of a row; null differs from every value, and columns do not run into each other."""
    cells = [F.col(f"`{c}`") for c in columns]
    nulls = [c.isNull() for c in cells]
    return F.struct(F.xxhash64(F.lit(1), *cells, *nulls).alias("a"), F.xxhash64(F.lit(2), *nulls, *cells).alias("b"))


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(change, key, copies, old, new): the rows that differ, repeats counted.

    ``change`` is inserted, deleted or changed; ``old`` and ``new`` are the rows as structs (null where
    there is none). A row that is there more often than before is inserted that many times more
    (``copies``), and the reverse; this is EXCEPT ALL both ways. A deleted and an inserted row of one
    known key make one changed row, in the order of their digests, as often as both go. Both tables
    have the same columns; only digests are shuffled for rows that stay, so an export that hardly
    changed costs little.
    """
    columns = old.columns
    tagged = old.select(row_digest(columns).alias("digest"), F.lit(-1).alias("n")).unionByName(
        new.select(row_digest(columns).alias("digest"), F.lit(1).alias("n"))
    )
    moved = materialize(tagged.groupBy("digest").agg(F.sum("n").alias("n")).where("n <> 0"), "moved")

    def rows(df: DataFrame, sign: int) -> DataFrame:
        mine = small_side(moved.where(F.col("n") * sign > 0))
        found = df.withColumn("_digest", row_digest(columns)).join(
            mine.select(F.col("digest").alias("_digest"), (F.col("n") * sign).alias("_n")), "_digest"
        )
        row = F.struct(*[F.col(f"`{c}`") for c in columns])
        once = found.groupBy("_digest").agg(F.min("_n").alias("copies"), F.any_value(row).alias("row"))
        return once.select(F.col("row")[key].alias("key"), F.col("_digest").alias("digest"), "copies", "row")

    # Copies of a key stand on a line in the order of their digests; where the lines of both sides
    # overlap, a row became another one.
    def placed(df: DataFrame) -> DataFrame:
        line = W.partitionBy("key").orderBy("digest").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("copies").over(line), F.lit(0))
        return df.withColumn("from", before).withColumn("to", before + F.col("copies"))

    gone, come = (placed(rows(df, sign)) for df, sign in ((old, -1), (new, 1)))
    gone = gone.select(*[F.col(c).alias(f"o_{c}") for c in ("key", "from", "to", "row")])
    come = come.select(*[F.col(c).alias(f"n_{c}") for c in ("key", "from", "to", "row")])
    gone, come = materialize(gone, "gone"), materialize(come, "come")
    shared = gone.join(
        come, (F.col("o_key") == F.col("n_key")) & (F.col("o_from") < F.col("n_to")) & (F.col("n_from") < F.col("o_to"))
    )
    low, high = F.greatest("o_from", "n_from"), F.least("o_to", "n_to")
    null = F.lit(None).cast(old.select(F.struct(*[F.col(f"`{c}`") for c in columns])).schema[0].dataType)
    changed = shared.select(
        F.lit("changed").alias("change"), F.col("o_key").alias("key"), (high - low).alias("copies"),
        F.col("o_row").alias("old"), F.col("n_row").alias("new"),
    )

    def alone(side: DataFrame, other: DataFrame, s: str, o: str, name: str) -> DataFrame:
        # What lies beyond the end of the other side's line of the key.
        ends = other.where(F.col(f"{o}_key").isNotNull()).groupBy(f"{o}_key").agg(F.max(f"{o}_to").alias("_end"))
        rest = side.join(ends, F.col(f"{s}_key") == F.col(f"{o}_key"), "left")
        over = F.col(f"{s}_to") - F.greatest(f"{s}_from", F.coalesce("_end", F.lit(0)))
        row = F.col(f"{s}_row")
        return rest.where(over > 0).select(
            F.lit(name).alias("change"), F.col(f"{s}_key").alias("key"), over.alias("copies"),
            (row if s == "o" else null).alias("old"), (row if s == "n" else null).alias("new"),
        )

    return changed.unionByName(alone(gone, come, "o", "n", "deleted")).unionByName(
        alone(come, gone, "n", "o", "inserted")
    )


def history(exports: DataFrame, key: str, snapshot: str = "snapshot") -> DataFrame:
    """(key, row, valid_from, valid_to): during which exports each version of a row was there.

    ``exports`` holds all exports, told apart by ``snapshot``. A version is valid from the first of
    consecutive exports that hold it until the next export without it (null if it is in the last). A
    version that comes back has two intervals; repeats within an export are one.
    """
    columns = [c for c in exports.columns if c != snapshot]
    order = W.orderBy(snapshot)
    dates = exports.select(snapshot).where(F.col(snapshot).isNotNull()).distinct()
    dates = materialize(
        dates.select(
            F.col(snapshot).alias("_date"), F.row_number().over(order).alias("_place"), F.lead(snapshot).over(order).alias("_next")
        ),
        "snapshots",
    )
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    seen = exports.select(row_digest(columns).alias("_digest"), row.alias("row"), F.col(snapshot).alias("_date"))
    once = seen.groupBy("_digest", "_date").agg(F.any_value("row").alias("row")).join(small_side(dates), "_date")
    version = W.partitionBy("_digest").orderBy("_place")
    islands = once.withColumn("_island", F.col("_place") - F.row_number().over(version))
    return (
        islands.groupBy("_digest", "_island")
        .agg(F.any_value("row").alias("row"), F.min("_date").alias("valid_from"), F.max_by("_next", "_place").alias("valid_to"))
        .select(F.col("row")[key].alias("key"), "row", "valid_from", "valid_to")
    )
