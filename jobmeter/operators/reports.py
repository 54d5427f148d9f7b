"""Histograms, outcome classes, user activity, missing values and schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.constants import NORMAL_P95, OUTCOMES


def bucket_counts(df: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """(position, bucket, job_count) of every bucket, empty ones included: one map-side pass."""
    counted = df.agg(*[F.count_if(test).alias(f"b{i}") for i, test in enumerate(buckets.values())])
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(b).alias("bucket"), F.col(f"b{i}").alias("job_count"))
        for i, b in enumerate(buckets)
    ]
    return counted.select(F.inline(F.array(*rows)))


def runtime_histogram(df: DataFrame, hours: Column) -> DataFrame:
    """Jobs per duration range; the ranges are half-open, plus one below and one above."""
    edges = [0.0, 0.1, 1.0, 6.0, 24.0, 168.0]
    names = ["0-6 min", "6-60 min", "1-6 hours", "6-24 hours", "1-7 days"]
    inside = {
        name: (hours >= low) & (hours < high)
        for name, low, high in zip(names, edges, edges[1:])
    }
    return bucket_counts(df, {"negative": hours < 0, **inside, "over 7 days": hours >= 168.0})


def cpu_histogram(df: DataFrame, cores: Column) -> DataFrame:
    return bucket_counts(
        df,
        {
            "1-4 cores": cores.between(1, 4),
            "5-16 cores": cores.between(5, 16),
            "17-64 cores": cores.between(17, 64),
            "65+ cores": cores >= 65,
        },
    )


def duration_classes(df: DataFrame, hours: Column) -> DataFrame:
    return bucket_counts(
        df,
        {"short": hours < 1, "medium": (hours >= 1) & (hours <= 24), "long": hours > 24},
    )


def outcome_rates(state_counts: DataFrame, state: str = "State") -> DataFrame:
    """Share of the most frequent state naming each outcome class; classes never seen are left out."""
    best = [
        F.min(
            F.when(
                F.col(state).contains(o),
                F.struct((-F.col("job_count")).alias("n"), F.col(state).alias("s"), F.col("percentage").alias("p")),
            )
        ).alias(o)
        for o in OUTCOMES
    ]
    rows = [
        F.struct(
            F.lit(o).alias("outcome"), F.col(f"{o}.s").alias("state"), F.col(f"{o}.p").alias("percentage")
        )
        for o in OUTCOMES
    ]
    return state_counts.agg(*best).select(F.inline(F.array(*rows))).where("state is not null")


def user_activity(user_counts: DataFrame) -> DataFrame:
    """Jobs per user (rounded), the busiest user's jobs, and users over 100 jobs: all, and in the top 20.

    ``user_counts`` comes from ``value_counts`` and carries the number of all rows.
    """
    top = user_counts.orderBy(F.desc("job_count")).limit(20)
    best = top.agg(F.count_if(F.col("job_count") > 100).alias("active_users_top20"))
    return user_counts.agg(
        F.round(F.try_divide(F.max("all_rows"), F.max("distinct_values"))).cast("long").alias("jobs_per_user"),
        F.max("job_count").alias("top_user_jobs"),
        F.count_if(F.col("job_count") > 100).alias("active_users"),
    ).join(best)


def user_share(user_counts: DataFrame, user: str) -> DataFrame:
    """Jobs of the five busiest users and of all others; ``job_count_top20`` stops after rank 20.

    The windows run over the top 20; the others' jobs are the known total less the top.
    """
    top = user_counts.orderBy(F.desc("job_count"), user).limit(20)
    rank = F.row_number().over(W.orderBy(F.desc("job_count"), user))
    label = F.when(F.col("_rank") <= 5, F.concat(F.lit("User "), F.col("_rank").cast("string")))
    shares = (
        top.withColumn("_rank", rank)
        .groupBy(F.coalesce(label, F.lit("Others")).alias("label"))
        .agg(F.sum("job_count").alias("job_count_top20"), F.max("known_rows").alias("_known"))
    )
    five = F.sum(F.when(F.col("label") != "Others", F.col("job_count_top20"))).over(W.partitionBy())
    count = F.when(F.col("label") == "Others", F.col("_known") - five).otherwise(F.col("job_count_top20"))
    return shares.select("label", count.alias("job_count"), "job_count_top20")


def runtime_p95(stats: DataFrame) -> DataFrame:
    """Rough (normal) and true 95th percentile from a row of mean, std and p95."""
    return stats.select(
        (F.col("mean") + F.lit(NORMAL_P95) * F.col("std")).alias("p95_estimate"),
        F.col("p95").alias("p95_true"),
    )


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """(table, field, type, known, missing) of every column: one map-side pass."""
    return profile_rows(df.agg(*profile_counts(df)), df, table)


def profile_counts(df: DataFrame) -> list[Column]:
    """The aggregates of a profile, for a pass that may count other things as well."""
    types = dict(df.dtypes)

    def missing(c: str) -> Column:
        test = F.col(f"`{c}`").isNull()
        return test | F.isnan(f"`{c}`") if types[c] in ("double", "float") else test

    return [
        *[F.count(f"`{c}`").alias(f"k{i}") for i, c in enumerate(df.columns)],
        *[F.count_if(missing(c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    ]


def profile_rows(counted: DataFrame, df: DataFrame, table: str) -> DataFrame:
    """The row of ``profile_counts`` as one row per column of ``df``."""
    rows = [
        F.struct(
            F.lit(table).alias("table"), F.lit(c).alias("field"), F.lit(t).alias("type"),
            F.col(f"k{i}").alias("known"), F.col(f"m{i}").alias("missing"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counted.select(F.inline(F.array(*rows)))


def missingness(df: DataFrame, table: str) -> DataFrame:
    """(table, field, missing) of the columns with missing values."""
    return column_profile(df, table).where("missing > 0").select("table", "field", "missing")


def schema_table(df: DataFrame) -> DataFrame:
    """(field, type, known): every column with its type and its number of known values."""
    counted = df.agg(*[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(c).alias("field"), F.lit(t).alias("type"), F.col(f"c{i}").alias("known"))
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counted.select(F.inline(F.array(*rows))).orderBy("field")
