"""Distribution summaries with exact quantiles that never gather a column in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.session import materialize

# Steps per unit of the first, logarithmic buckets; linear buckets of each later pass; rows up to
# which a bucket's distinct values are sorted by one task.
LOG_STEPS = 200
LINEAR_STEPS = 4096
SORTABLE_ROWS = 200_000


@dataclass(frozen=True)
class Hit:
    """A bucket that holds wanted ranks: all of the metric's values from ``low`` to ``high``."""

    metric: str
    low: float
    high: float
    rows: int
    before: int
    ranks: tuple[int, ...]


def long_values(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """One row (metric, value) per known number of the given columns."""
    pairs = [
        F.struct(F.lit(name).alias("metric"), F.nanvl(c.cast("double"), F.lit(None)).alias("value"))
        for name, c in metrics.items()
    ]
    return df.select(F.inline(F.array(*pairs))).where("value is not null")


def _log_bucket(value: Column) -> Column:
    # Any monotone function will do; this one keeps the bucket count small for any spread.
    size = F.log1p(F.abs(value) * 1e6) * LOG_STEPS
    return F.floor(F.signum(value) * size).cast("long")


def _histogram(values: DataFrame) -> DataFrame:
    """Logarithmic buckets of every metric: rows, extremes, rows before, and the metric's moments.

    Bucket moments combine as M2 = sum(n * (var + (mean - grand mean)^2)).
    """
    v, n = F.col("value"), F.col("n")
    metric = W.partitionBy("metric")
    buckets = values.groupBy("metric", _log_bucket(v).alias("b1")).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("var"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    )
    totals = buckets.withColumn("count", F.sum(n).over(metric)).withColumn(
        "grand", F.sum(n * F.col("mean")).over(metric) / F.col("count")
    )
    spread = F.sum(n * (F.col("var") + F.pow(F.col("mean") - F.col("grand"), F.lit(2)))).over(metric)
    stats = F.struct(
        "count",
        F.col("grand").alias("mean"),
        F.sqrt(F.try_divide(spread, F.col("count") - 1)).alias("std"),
        F.min("low").over(metric).alias("min"),
        F.max("high").over(metric).alias("max"),
    )
    return totals.select(
        "metric", "n", "low", "high", _rows_before("metric", "b1").alias("before"), stats.alias("stats")
    )


def _rows_before(*keys: str) -> Column:
    """Rows in earlier buckets of the same group; the last key orders the buckets."""
    *group, order = keys
    upto = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.sum("n").over(upto) - F.col("n")


def _wanted(table: DataFrame) -> DataFrame:
    """Keep the buckets that hold a wanted rank; ``ranks`` shrinks to the ranks inside."""
    inside = F.filter(
        "ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))
    )
    return table.withColumn("ranks", inside).where(F.size("ranks") > 0)


def _inside(values: DataFrame, hits: Sequence[Hit]) -> DataFrame:
    """Rows of ``values`` inside one of the hits, with the hit's number and properties."""
    number = F.coalesce(
        *[
            F.when((F.col("metric") == h.metric) & F.col("value").between(h.low, h.high), F.lit(i))
            for i, h in enumerate(hits)
        ]
    )
    return values.withColumn("hit", number).where("hit is not null")


def _located(counted: DataFrame, hits: Sequence[Hit], order: str) -> list[Hit]:
    """The buckets of ``counted`` (hit, order, n, low, high) that hold the hits' ranks.

    At most one row per wanted rank reaches the driver.
    """
    def of_hit(items: list[Column]) -> Column:
        return F.element_at(F.array(*items), F.col("hit") + 1)

    ranks = of_hit([F.array(*[F.lit(r).cast("long") for r in h.ranks]) for h in hits])
    before = of_hit([F.lit(h.before).cast("long") for h in hits]) + _rows_before("hit", order)
    found = _wanted(counted.withColumn("before", before).withColumn("ranks", ranks))
    return [
        Hit(hits[r.hit].metric, r.low, r.high, r.n, r.before, tuple(r.ranks))
        for r in found.select("hit", "low", "high", "n", "before", "ranks").collect()
    ]


def _narrowed(values: DataFrame, hits: Sequence[Hit]) -> list[Hit]:
    """Split every hit into equal-width buckets and keep those that hold its ranks."""
    def of_hit(items: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in items]), F.col("hit") + 1)

    low, width = of_hit([h.low for h in hits]), of_hit([h.high - h.low for h in hits])
    bucket = F.floor((F.col("value") - low) / width * LINEAR_STEPS)
    counted = _inside(values, hits).groupBy("hit", bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return _located(counted, hits, "bucket")


def _sorted_out(values: DataFrame, hits: Sequence[Hit]) -> list[Hit]:
    """Rank the distinct values inside the hits: every result is a single value."""
    counted = (
        _inside(values, hits)
        .groupBy("hit", "value")
        .agg(F.count("*").alias("n"))
        .withColumns({"low": F.col("value"), "high": F.col("value")})
    )
    return _located(counted, hits, "value")


def _exact_summaries(values: DataFrame, probs: Sequence[float]) -> list[tuple[str, Row, list[float]]]:
    """(metric, moments, quantiles) of every metric.

    One pass counts logarithmic buckets. Only the few buckets that hold a wanted rank matter after
    that: a bucket of one value is an answer, a small one has its distinct values ranked, a large
    one (however skewed the data) is split again until it is small. Each pass is a scan combined
    map-side; no task sees more than a bucket table or ``SORTABLE_ROWS`` values, and the driver
    only sees the hit buckets, two per quantile at most.
    """
    last = F.col("stats.count") - 1
    wanted = [r for p in probs for r in (F.floor(F.lit(p) * last), F.ceil(F.lit(p) * last))]
    first = _wanted(_histogram(values).withColumn("ranks", F.array_distinct(F.array(*wanted)))).collect()
    stats = {row.metric: row.stats for row in first}
    open_hits = [Hit(r.metric, r.low, r.high, r.n, r.before, tuple(r.ranks)) for r in first]
    at: dict[tuple[str, int], float] = {}
    while open_hits:
        at |= {(h.metric, r): h.low for h in open_hits if h.low == h.high for r in h.ranks}
        spread = [h for h in open_hits if h.low < h.high]
        large = [h for h in spread if h.rows > SORTABLE_ROWS]
        small = [h for h in spread if h.rows <= SORTABLE_ROWS]
        open_hits = (_narrowed(values, large) if large else []) + (
            _sorted_out(values, small) if small else []
        )

    def quantile(metric: str, p: float) -> float:
        place = p * (stats[metric]["count"] - 1)
        low, high = at[metric, floor(place)], at[metric, ceil(place)]
        return low + (high - low) * (place - floor(place))

    return [(m, row, [quantile(m, p) for p in probs]) for m, row in sorted(stats.items())]


SUMMARY_SCHEMA = (
    "metric string, count bigint, mean double, std double, min double, max double, "
    "quantiles array<double>"
)


def summarize(
    df: DataFrame, metrics: Mapping[str, Column], probs: Sequence[float], exact: bool = True
) -> DataFrame:
    """One row per metric: count, mean, std, min, max and an array ``quantiles`` in ``probs`` order.

    Quantiles interpolate linearly between ranks. This runs at once, while the plan is built: the
    numbers are written to the shared folder as narrow (metric, value) rows, so that the source is
    read once however many passes follow.
    ``exact=False`` takes quantiles from Spark's bounded sketch instead, lazily and in one pass.
    """
    values = long_values(df, metrics)
    if exact:
        values = materialize(values, "values")
        rows = [
            (m, s["count"], s["mean"], s["std"], s["min"], s["max"], q)
            for m, s, q in _exact_summaries(values, probs)
        ]
        return df.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)
    return values.groupBy("metric").agg(
        F.count("*").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.percentile_approx("value", list(probs)).alias("quantiles"),
    )


def describe(df: DataFrame, metrics: Mapping[str, Column], exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles and max per metric."""
    q = F.col("quantiles")
    return summarize(df, metrics, (0.25, 0.5, 0.75), exact).select(
        "metric", "count", "mean", "std", "min",
        q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), "max",
    )


def summary_stats(df: DataFrame, metrics: Mapping[str, Column], exact: bool = True) -> DataFrame:
    """count, min, max, mean, median and p95 per metric."""
    q = F.col("quantiles")
    return summarize(df, metrics, (0.5, 0.95), exact).select(
        "metric", "count", "min", "max", "mean", q[0].alias("median"), q[1].alias("p95")
    )
