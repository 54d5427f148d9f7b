"""Mixing sources to target weights by entropy balancing.

Each source has a word target. Among all document rates that meet it, entropy balancing takes those
closest to one copy each (in relative entropy) with an upper bound. The solution is an exponential
tilt: rate = min(cap, exp(lambda * size / scale)), one lambda per source, found by Newton steps on
the convex dual. Rates depend on source and size only, so the steps run on counted cells (source,
size) and not on documents. Rates become whole copies by cumulative rounding over the cells of a
source, largest sizes first, which keeps a source's error below about the size of one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.llm.tables import WORD, col, packed, unpacked
from jobmeter.operators.lookups import small_side
from jobmeter.session import materialize

STEPS = 60
TOLERANCE = 1e-9
ROWS_PER_SPREAD = 1_000_000


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """Word targets of sources from (key, size): share of all words by weight, at most cap times a source.

    Weights repeat over the keys in code-point order. What a capped source cannot take is shared
    again by weight until no source is above its cap. With sources in order of limit / weight, the
    level at a source is what each unit of weight gets if all sources before it stop at their limit;
    the first level that the source itself can take (it is the largest such) holds for all. The
    windows have no partition because the table has one row per source.
    """
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.pmod(F.row_number().over(W.orderBy("key")) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    order = W.orderBy(F.col("limit") / F.col("weight"), "key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    return (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("limit", F.lit(cap) * F.col("size"))
        .withColumn("wanted", F.sum("size").over(every) * F.lit(share))
        .withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn(
            "open", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
        )
        .withColumn("level", (F.col("wanted") - F.col("full")) / F.col("open"))
        .withColumn(
            "rest",
            F.max(
                F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
            ).over(every),
        )
        .select(
            "key",
            "size",
            F.coalesce(
                F.least(F.col("limit").cast("double"), F.col("weight") * F.col("rest")),
                F.col("limit").cast("double"),
            ).alias("target"),
        )
    )


def _rate(cap: int) -> Column:
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(float(cap))))
    return (
        F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap)))
        .when(F.col("target") <= 0, F.lit(0.0))
        .otherwise(F.least(tilt, F.lit(float(cap))))
    )


def balance(cells: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """(key, source_size, target, scale, lam) with the tilt of every source.

    Each step is one distributed aggregate over the cells: words taken and their derivative per
    source. The next lambda is a Newton step on log(words / target), or the middle of the bracket
    if that leaves it. Sums are decimal, so that they do not depend on the order of addition and
    reruns agree to the last bit.
    """
    shape = cells.where("size > 0").groupBy("key").agg(
        (F.sum(F.col("n") * F.col("size").cast("decimal(20,0)") * F.col("size"))
         / F.sum(F.col("n") * F.col("size"))).cast("double").alias("scale"),
        F.min("size").alias("least"),
    )
    ratio = F.when((F.col("target") > 0) & (F.col("source_size") > 0),
                   F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    steepest = F.col("log_ratio") * F.col("scale") / F.col("least")
    state = (
        targets.withColumnRenamed("size", "source_size")
        .join(shape, "key", "left")
        .fillna({"scale": 1.0, "least": 1})
        .withColumn("log_ratio", F.log(ratio))
        .select("key", "source_size", "target", "scale",
                F.col("log_ratio").alias("lam"),
                F.least(F.lit(0.0), steepest).alias("lo"),
                F.greatest(F.lit(0.0), steepest).alias("hi"))
    )
    state = materialize(state, "tilts")
    held = ["source_size", "target", "scale", "lam", "lo", "hi"]
    rate = _rate(cap)
    words = F.col("n") * F.col("size")
    for _ in range(STEPS):
        slope = F.when(rate < cap, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = cells.where("size > 0").join(small_side(state), "key").groupBy("key").agg(
            *[F.first(c).alias(c) for c in held],
            F.sum((words * rate).cast("decimal(28,8)")).cast("double").alias("f"),
            F.sum(slope.cast("decimal(28,8)")).cast("double").alias("g"),
        )
        free = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size"))
        error = F.when(free, F.abs(F.col("f") / F.col("target") - 1)).otherwise(F.lit(0.0))
        over = F.col("f") > F.col("target")
        lo = F.when(over, F.col("lo")).otherwise(F.col("lam"))
        hi = F.when(over, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.log(F.col("f") / F.col("target")) * F.col("f") / F.col("g")
        inside = (F.col("g") > 0) & (F.col("f") > 0) & (newton > lo) & (newton < hi)
        step = F.when(error <= TOLERANCE, F.col("lam")).when(inside, newton).otherwise((lo + hi) / 2)
        seen = Observation()
        state = materialize(
            sums.select("key", "source_size", "target", "scale", step.alias("lam"), lo.alias("lo"),
                        hi.alias("hi"), error.alias("error")).observe(seen, F.max("error").alias("most")),
            "tilts",
        )
        if (seen.get["most"] or 0.0) <= TOLERANCE:
            break
    return state


def _dealt(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The packed rows of ``docs`` with size, source_size, target and copies."""
    # Names that begin with 'a' keep their code-point order; null comes after them as 'b'.
    sized = packed(
        docs,
        keep,
        id=col(doc_id).cast("string"),
        key=F.coalesce(F.concat(F.lit("a"), col(source).cast("string")), F.lit("b")),
        size=word_count(col(text)),
    )
    spread = max(512, docs.count() // ROWS_PER_SPREAD)
    place = F.pmod(F.xxhash64("id", "size"), F.lit(spread))
    sub = sized.groupBy("key", "size", place.alias("place")).agg(F.count("*").alias("m"))
    sub = materialize(sub, "cells")
    cells = materialize(sub.groupBy("key", "size").agg(F.sum("m").alias("n")), "cells")
    sizes = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("size"))
    targets = materialize(source_targets(sizes, weights, share, cap), "targets")
    tilts = balance(cells, targets, cap)

    # All cells of a source pass one task here: at most as many as there are different sizes.
    down = W.partitionBy("key").orderBy(F.desc("size"))
    running = F.sum((F.col("n") * F.col("rate")).cast("decimal(28,10)")).over(down)
    upto = F.floor(running + F.expr("0.5")).cast("long")
    sources = targets.withColumnRenamed("size", "source_size").join(
        tilts.select("key", "scale", "lam"), "key", "left"
    ).fillna({"scale": 1.0, "lam": 0.0})
    dealt = (
        cells.join(small_side(sources), "key")
        .withColumn("rate", _rate(cap))
        .withColumn("upto", upto)
        .withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))
        .select("key", "size", "source_size", "target",
                F.floor(F.col("copies") / F.col("n")).cast("int").alias("each"),
                F.pmod("copies", "n").cast("decimal(19,0)").alias("extra"), "n")
    )
    across = W.partitionBy("key", "size").orderBy("place")
    share_upto = F.floor(F.col("extra") * F.sum("m").over(across) / F.col("n")).cast("long")
    quotas = (
        sub.join(dealt, ["key", "size"])
        .withColumn("upto", share_upto)
        .withColumn("quota", F.col("upto") - F.coalesce(F.lag("upto").over(across), F.lit(0)))
        .select("key", "size", "place", "source_size", "target", "each", "quota")
    )
    rank = F.row_number().over(
        W.partitionBy("key", "size", "place").orderBy(F.xxhash64("id"), "id")
    )
    return (
        sized.withColumn("place", place)
        .withColumn("rank", rank)
        .join(quotas, ["key", "size", "place"])
        .withColumn("copies", F.col("each") + (F.col("rank") <= F.col("quota")).cast("int"))
    )


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies and taken.

    ``size`` is the number of words, ``target`` and ``source_size`` are words of the row's source,
    ``copies`` (0 to ``cap``) says how often the mix takes the row and ``taken`` = copies * size.
    Result columns replace columns of the same name; the others pass through (``keep`` names those
    that do, where not all are wanted).

    Null text has size 0 and null source is a source of its own, after all others. Documents of
    equal source and size are equal to the method; which of them get the extra copy is decided by
    a hash of doc_id, then doc_id. Repeated rows are documents of their own. Where all texts are
    empty every target is 0. An empty table gives an empty table.
    """
    chosen = _dealt(docs, doc_id, text, source, weights, share, cap, keep)
    return unpacked(
        chosen,
        docs.columns if keep is None else keep,
        {
            "size": F.col("size"),
            "source_size": F.col("source_size").cast("long"),
            "target": F.col("target"),
            "copies": F.col("copies"),
            "taken": (F.col("size") * F.col("copies")).cast("long"),
        },
    )


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return unpacked(_dealt(docs, **options).where("copies > 0").select("row", copies), docs.columns, {})
