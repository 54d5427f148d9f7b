"""Usage and energy per user, account, state, job type, day and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.constants import TARGET_COLUMN
from jobmeter.functions.times import day_text

START_DAY = "start_day"
START_HOUR = "start_hour"


def energy_columns(mean: bool = True) -> list[Column]:
    columns = [
        F.count("*").alias("job_count"),
        F.coalesce(F.sum(TARGET_COLUMN), F.lit(0.0)).alias("energy_total_kwh"),
    ]
    return columns + [F.avg(TARGET_COLUMN).alias("energy_mean_kwh")] if mean else columns


def wait_columns() -> list[Column]:
    return [
        F.avg("queue_wait_time_hours").alias("queue_wait_time_hours_mean"),
        F.avg("requested_walltime_hours").alias("requested_walltime_hours_mean"),
    ]


def usage_by(features: DataFrame, column: str, name: str) -> DataFrame:
    """Jobs, energy and mean waits per known value of ``column``; combined map-side."""
    return (
        features.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(name))
        .agg(*energy_columns(), *wait_columns())
    )


def by_user(features: DataFrame) -> DataFrame:
    return usage_by(features, "User", "user")


def by_account(features: DataFrame) -> DataFrame:
    return usage_by(features, "Account", "account")


def by_state(features: DataFrame) -> DataFrame:
    return usage_by(features, "State", "state")


def by_job_type(features: DataFrame) -> DataFrame:
    return usage_by(features, "job_type", "job_type")


def job_type_breakdown(features: DataFrame) -> DataFrame:
    return features.groupBy("job_type").agg(*energy_columns())


def energy_by_user(features: DataFrame) -> DataFrame:
    return (
        features.where(F.col("User").isNotNull())
        .groupBy(F.col("User").alias("user"))
        .agg(F.sum(TARGET_COLUMN).alias("energy_total_kwh"))
    )


def top_users_by_energy(features: DataFrame, k: int = 10) -> DataFrame:
    return energy_by_user(features).orderBy(F.desc("energy_total_kwh"), "user").limit(k)


def _started(features: DataFrame) -> DataFrame:
    return features.where(F.col("Start").isNotNull())


def by_day(features: DataFrame) -> DataFrame:
    """Per UTC start day."""
    days = _started(features).groupBy(F.to_date("Start").alias(START_DAY)).agg(*energy_columns())
    return days.withColumn(START_DAY, day_text(F.col(START_DAY)))


def by_hour_of_day(features: DataFrame) -> DataFrame:
    """Per UTC start hour, 0 to 23."""
    return _started(features).groupBy(F.hour("Start").alias(START_HOUR)).agg(*energy_columns())


def by_day_hour(features: DataFrame) -> DataFrame:
    """Sparse (day, hour) cells."""
    return (
        _started(features)
        .groupBy(F.to_date("Start").alias(START_DAY), F.hour("Start").alias(START_HOUR))
        .agg(*energy_columns(mean=False))
        .withColumn(START_DAY, day_text(F.col(START_DAY)))
    )


def dataset_summary(features: DataFrame) -> DataFrame:
    """Jobs, distinct users, time range and whole days covered."""
    return dataset_row(features.agg(*dataset_counts(), F.countDistinct("User").alias("unique_users")))


def dataset_counts() -> list[Column]:
    """Aggregates that a pass over the features may take along for the summary."""
    return [F.count("*").alias("job_count"), F.min("Start").alias("_start"), F.max("End").alias("_end")]


def dataset_row(counted: DataFrame) -> DataFrame:
    """The summary from a row of ``dataset_counts`` and unique_users."""
    days = F.ceil((F.unix_micros("_end") - F.unix_micros("_start")) / F.lit(86_400_000_000.0))
    return counted.select(
        "job_count",
        "unique_users",
        F.date_format("_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("range_start"),
        F.date_format("_end", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("range_end"),
        F.greatest(F.lit(1).cast("long"), days).alias("total_days"),
    )


def categorical_distribution(features: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) of the known values of the given text columns."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        features.select(F.inline(pairs))
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.count("*").alias("job_count"))
    )
