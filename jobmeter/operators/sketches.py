"""Mergeable daily sketches: quantiles and distinct users of any range of days without the jobs.

A day's sketch is a few kilobytes whatever the number of its jobs. Sketches of days merge into the
sketch of a range, so a dashboard asks for any range and only the rows of its days are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.session import materialize

METRICS = ("energy_kWh", "requested_walltime_hours", "queue_wait_time_hours")
KLL_K = 800
HLL_LOG = 16
THETA_LOG = 14
DAY = "start_day"


def rank_error(k: int = KLL_K) -> float:
    """Share of the rows by which the rank of a quantile from a sketch of size ``k`` may be off (99 %)."""
    return 2.296 / k**0.9723


def hll_error(log_size: int = HLL_LOG) -> float:
    """Relative standard error of a distinct count from registers of that size."""
    return 1.04 / 2 ** (log_size / 2)


def daily_quantile_sketches(
    jobs: DataFrame, metrics: Iterable[str] = METRICS, at: str = "Start", k: int = KLL_K
) -> DataFrame:
    """(start_day, metric, known, sketch): one quantile sketch per start day and metric.

    Null and NaN count nowhere; a day without any known value of a metric has no row for it. Jobs
    without start are left out. One pass; partial sketches are merged, never rows.
    """
    columns = list(metrics)
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    dated = jobs.where(F.col(at).isNotNull()).select(
        F.to_date(at).alias(DAY), *[known[c].alias(f"m{i}") for i, c in enumerate(columns)]
    )
    aggregates: list[Column] = []
    for i in range(len(columns)):
        aggregates += [F.count(f"m{i}").alias(f"n{i}"), F.kll_sketch_agg_double(f"m{i}", F.lit(k)).alias(f"s{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.col(f"n{i}").alias("known"), F.col(f"s{i}").alias("sketch"))
            for i, c in enumerate(columns)
        ]
    )
    return dated.groupBy(DAY).agg(*aggregates).select(DAY, F.inline(rows)).where("known > 0")


def daily_user_sketches(jobs: DataFrame, user: str = "User", at: str = "Start") -> DataFrame:
    """(start_day, users, members): sketches of a day's distinct users, to be counted and to be intersected."""
    dated = jobs.where(F.col(at).isNotNull() & F.col(user).isNotNull())
    return dated.groupBy(F.to_date(at).alias(DAY)).agg(
        F.hll_sketch_agg(user, HLL_LOG).alias("users"), F.theta_sketch_agg(user, THETA_LOG).alias("members")
    )


def _in_ranges(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sketches of every day of every range (name, first_day, last_day), both ends included.

    Ranges are spelled out into days, so this is an equi-join.
    """
    days = F.explode(F.sequence(F.col("first_day").cast("date"), F.col("last_day").cast("date")))
    wanted = ranges.where("first_day <= last_day").select("name", days.alias(DAY)).distinct()
    return sketches.join(wanted, DAY)


def quantiles(sketches: DataFrame, ranges: DataFrame, shares: Iterable[float] = (0.5, 0.95)) -> DataFrame:
    """(name, metric, known, quantiles): the quantiles of each range from the sketches of its days alone.

    ``quantiles`` is an array in the order of ``shares``; ranks are within ``rank_error``. Ranges
    without a known value have no row.
    """
    merged = _in_ranges(sketches, ranges).groupBy("name", "metric").agg(
        F.sum("known").alias("known"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    wanted = F.array(*[F.lit(float(x)) for x in shares])
    return merged.select(
        "name", "metric", "known", F.kll_sketch_get_quantile_double("sketch", wanted).alias("quantiles")
    )


def distinct_users(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """(name, users): about how many different users each range has, from daily sketches."""
    merged = _in_ranges(sketches, ranges).groupBy("name").agg(F.hll_union_agg("users").alias("users"))
    return merged.select("name", F.hll_sketch_estimate("users").alias("users"))


def shared_users(sketches: DataFrame, ranges: DataFrame, pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(a, b, shared): how many users two ranges have in common, for the given pairs (a, b) of names.

    Exact while each of both ranges has fewer than 2 ** THETA_LOG users, else an estimate. With ``members``
    (start_day, User; see ``daily_members``) pairs with a larger range are counted from these rows.
    """
    merged = _in_ranges(sketches, ranges).groupBy("name").agg(F.theta_union_agg("members", THETA_LOG).alias("members"))
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("name"))
    met = sides.join(merged, "name").groupBy("a", "b").agg(
        F.theta_sketch_estimate(F.theta_intersection_agg("members")).alias("shared"),
        F.count_distinct("name").alias("found"),
        F.max(F.theta_sketch_estimate("members")).alias("most"),
    )
    full = F.col("found") == F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    met = met.select("a", "b", F.when(full, F.col("shared")).otherwise(F.lit(0)).cast("long").alias("shared"), (full & (F.col("most") >= 2**THETA_LOG)).alias("large"))
    if members is None:
        known = met.select("a", "b", "shared")
    else:
        met = materialize(met, "pairs")
        large = met.where("large").select("a", "b")
        known = met.where("not large").select("a", "b", "shared").unionByName(_counted(members, ranges, large))
    return pairs.distinct().join(known, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))


def daily_members(jobs: DataFrame, user: str = "User", at: str = "Start") -> DataFrame:
    """(start_day, User): the distinct users of each day themselves."""
    dated = jobs.where(F.col(at).isNotNull() & F.col(user).isNotNull())
    return dated.select(F.to_date(at).alias(DAY), F.col(user).alias("User")).distinct()


def _counted(members: DataFrame, ranges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared) by counting the users of both ranges; a pair without a common user has no row."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    sets = _in_ranges(members, ranges.join(asked, "name", "left_semi")).select("name", "User").distinct()
    # Grouped by user, so that no range is one key.
    both = (
        pairs.join(sets.select(F.col("name").alias("a"), "User"), "a")
        .join(sets.select(F.col("name").alias("b"), "User"), ["b", "User"])
    )
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"))
