"""Seeded sample of exact size, and folds that keep a user's jobs together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.constants import FOLDS, MAX_SAMPLES, SEED
from jobmeter.operators.lookups import small_side
from jobmeter.operators.ranking import with_position
from jobmeter.session import materialize


def sample_digest(keys: Sequence[str] = ("job_key", "JobID"), seed: int = SEED) -> Column:
    """The seeded hash by which rows are drawn."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def _bit_length(digest: Column) -> Column:
    return F.length(F.bin(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")))


def cutoffs(digests: DataFrame, max_samples: int, folds: int = 1) -> list[str | None]:
    """For each fold the ``max_samples``-th smallest digest of all *other* folds, None if they have no more rows.

    ``digests`` is a table (fold, digest); with one fold, whose number is -1, the cut-off is that of
    all rows. A first pass counts digests by their bit length (at most 32 rows per task and fold);
    only rows up to the shortest length that holds enough are ordered, about twice the sample.
    """
    numbers = [-1] if folds == 1 else list(range(folds))
    bits = _bit_length(F.col("digest"))
    counted = digests.groupBy("fold", bits.alias("bits")).count().collect()

    def others(fold: int, most: int) -> int:
        return sum(r["count"] for r in counted if (fold < 0 or r["fold"] != fold) and r["bits"] <= most)

    wanted = {f: next((b for b in range(33) if others(f, b) >= max_samples), None) for f in numbers}
    if all(b is None for b in wanted.values()):
        return [None for _ in numbers]
    candidates = digests.where(bits <= max(b for b in wanted.values() if b is not None))
    upto = W.orderBy("digest", "fold").rowsBetween(W.unboundedPreceding, W.currentRow)
    passed = candidates.select(
        "digest", *[F.count_if((F.col("fold") != f) | F.lit(f < 0)).over(upto).alias(f"n{i}") for i, f in enumerate(numbers)]
    )
    row = passed.agg(
        *[F.min(F.when(F.col(f"n{i}") >= max_samples, F.col("digest"))).alias(f"c{i}") for i in range(len(numbers))]
    ).first()
    return [row[f"c{i}"] if wanted[f] is not None else None for i, f in enumerate(numbers)]


def _drawn(df: DataFrame, digest: Column, cutoff: str | None, max_samples: int) -> DataFrame:
    """The rows up to a cut-off; rows with equal keys are ordered by all their columns."""
    if cutoff is None:
        return df
    ties = [c for c, t in df.dtypes if not t.startswith("map")]
    return (
        df.where(digest <= cutoff)
        .withColumn("_digest", digest)
        .orderBy("_digest", *[F.col(f"`{c}`") for c in ties])
        .limit(max_samples)
        .drop("_digest")
    )


def sample_cap(
    df: DataFrame,
    max_samples: int = MAX_SAMPLES,
    seed: int = SEED,
    keys: Sequence[str] = ("job_key", "JobID"),
    ignore_limits: bool = False,
) -> DataFrame:
    """At most ``max_samples`` rows, the ones with the smallest seeded hash of their keys.

    The same rows come out in every run and on every cluster layout. The hashes alone are written and
    give a cut-off (see ``cutoffs``); the rows below it are then taken from ``df``. The cut-off is a
    filter on the keys, which Spark moves below joins and into scans, so only the sample has all its
    columns computed and nothing of full width is written.
    """
    if ignore_limits:
        return df
    digest = sample_digest(keys, seed)
    digests = materialize(df.select(F.lit(-1).alias("fold"), digest.alias("digest")), "digests")
    return _drawn(df, digest, cutoffs(digests, max_samples)[0], max_samples)


def fold_samples(
    df: DataFrame, folds: int, max_samples: int, seed: int = SEED, keys: Sequence[str] = ("job_key", "JobID")
) -> list[DataFrame]:
    """For each fold the sample of all rows of the other folds, as ``sample_cap`` draws it.

    The hashes are written once and serve all folds.
    """
    digest = sample_digest(keys, seed)
    digests = materialize(df.select("fold", digest.alias("digest")), "digests")
    return [
        _drawn(df.where(F.col("fold") != fold), digest, cutoff, max_samples)
        for fold, cutoff in enumerate(cutoffs(digests, max_samples, folds))
    ]


def group_sizes(df: DataFrame, group: str = "User") -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("size"))


def _deal_equal(loads: list[int], size: int, count: int) -> Iterator[tuple[int, list[int]]]:
    """How ``count`` groups of one ``size`` fall to folds: (first position, folds in turn), and
    the loads brought up to date.

    Each group goes to the lightest fold, the first among equals. Folds less than one group above
    the lightest take turns, round by round, until the next fold comes within reach: there are at
    most as many cycles as folds, however many groups.
    """
    at = 0
    while at < count:
        order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
        lightest = order[0]
        edge = (loads[lightest] + size, lightest)
        turn = [f for f in order if (loads[f], f) < edge]
        rounds = (count - at) // len(turn)
        if len(turn) < len(order):
            last, heavier = turn[-1], order[len(turn)]
            # Whole rounds that end before the next fold's turn.
            gap = loads[heavier] - loads[last]
            rounds = min(rounds, gap // size + int(gap % size > 0 or last < heavier))
        yield at, turn
        for place, f in enumerate(turn):
            loads[f] += size * (rounds if rounds else int(place < count - at))
        at += max(rounds * len(turn), 1) if rounds else count - at


def fold_table(df: DataFrame, k: int = FOLDS, group: str = "User", mode: str = "greedy") -> DataFrame:
    """(group, size, fold): groups by size, the largest first.

    ``greedy`` gives each group to the fold with the fewest rows so far. The driver sees the sizes
    that occur and how often (distinct sizes of n rows number at most about the root of 2 n), never
    the groups; groups of one size are dealt by their position. ``snake`` deals back and forth
    (0..k-1, k-1..0, ...). Equal sizes are in order of the group, a missing group first; it is one
    group. Fewer groups than folds is an error.
    """
    if mode not in ("greedy", "snake"):
        raise ValueError(f"unknown mode {mode!r}")
    placed = with_position(group_sizes(df, group), [F.desc("size"), F.asc_nulls_first(group)])
    if mode == "snake":
        groups = placed.count()
        turn = F.col("position") % (2 * k)
        fold = F.when(turn < k, turn).otherwise(2 * k - 1 - turn)
        dealt = placed.select(group, "size", fold.cast("int").alias("fold"))
    else:
        counted = placed.groupBy("size").agg(F.count("*").alias("n"), F.min("position").alias("first"))
        loads, cycles, groups = [0] * k, [], 0
        for row in counted.orderBy(F.desc("size")).toLocalIterator():
            groups += row["n"]
            found = list(_deal_equal(loads, row["size"], row["n"]))
            ends = [row["first"] + at for at, _ in found[1:]] + [row["first"] + row["n"]]
            cycles += [(row["size"], row["first"] + at, end, turn) for (at, turn), end in zip(found, ends)]
        table = df.sparkSession.createDataFrame(cycles, "_size long, _from long, _to long, _turn array<int>")
        here = (F.col("size") == F.col("_size")) & F.col("position").between(F.col("_from"), F.col("_to") - 1)
        place = (F.col("position") - F.col("_from")) % F.size("_turn")
        dealt = placed.join(small_side(table), here).select(
            group, "size", F.get("_turn", place.cast("int")).alias("fold")
        )
    if groups < k:
        raise ValueError(f"cannot make {k} folds out of {groups} groups")
    return dealt


def group_folds(df: DataFrame, k: int = FOLDS, group: str = "User", mode: str = "greedy") -> DataFrame:
    """Add ``fold``; all rows of a group share it. For ``greedy`` and ``snake`` see ``fold_table``.

    ``mode='hash'`` assigns by hash without looking at sizes: no shuffle, folds uneven.
    """
    if mode == "hash":
        return df.withColumn("fold", F.pmod(F.xxhash64(F.col(group).cast("string")), k).cast("int"))
    folds = fold_table(df, k, group, mode).select(F.col(group).alias("_group"), "fold")
    return df.join(small_side(folds), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
