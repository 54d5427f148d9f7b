"""Trends over the daily and hourly tables.

The windows here have no partition on purpose: their inputs are tables of days or hours (a century
has 36,525 days), produced by a distributed aggregation over the jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from jobmeter.constants import (
    ANOMALY_MAD_FACTOR,
    ANOMALY_MAD_FLOOR,
    ANOMALY_VOLUME_FACTOR,
    PEAK_PERCENTILE,
    ROLLING_ROWS,
)
from jobmeter.operators.usage import START_DAY, START_HOUR


def all_rows() -> WindowSpec:
    return W.partitionBy()


def _by_day() -> WindowSpec:
    return W.orderBy(START_DAY)


def sort_by_day(by_day: DataFrame) -> DataFrame:
    return by_day.orderBy(START_DAY)


def _per_job() -> Column:
    ratio = F.try_divide(F.col("energy_total_kwh"), F.col("job_count"))
    return F.when(F.col("job_count") > 0, ratio).otherwise(F.lit(0.0))


def energy_per_job_columns(table: DataFrame) -> DataFrame:
    """Add energy per job of each row, 0 where there are no jobs."""
    return table.withColumn("energy_per_job_kwh", _per_job())


def _rolling(column: str) -> Column:
    return F.avg(column).over(_by_day().rowsBetween(1 - ROLLING_ROWS, 0))


def rolling7(by_day: DataFrame) -> DataFrame:
    """Add trailing means over the last seven rows (fewer at the start)."""
    return energy_per_job_columns(by_day).withColumns(
        {
            "rolling7_job_count": _rolling("job_count"),
            "rolling7_energy_mean_kwh": _rolling("energy_mean_kwh"),
            "rolling7_energy_total_kwh": _rolling("energy_total_kwh"),
            "rolling7_energy_per_job_kwh": _rolling("energy_per_job_kwh"),
        }
    )


def _peak(column: str) -> Column:
    """At or above the nearest-rank percentile, or above both neighbours."""
    value = F.col(column)
    threshold = F.expr(f"percentile_disc({PEAK_PERCENTILE}) within group (order by {column}) over ()")
    before = F.coalesce(F.lag(column).over(_by_day()), value)
    after = F.coalesce(F.lead(column).over(_by_day()), value)
    local = (value > before) & (value > after) & (F.count("*").over(all_rows()) > 2)
    return (value >= threshold) | local


def peak_flags(by_day: DataFrame) -> DataFrame:
    return by_day.withColumns(
        {"peakVolume": _peak("job_count"), "peakEnergyTotal": _peak("energy_total_kwh")}
    )


def _with_median_mad(table: DataFrame) -> DataFrame:
    table = table.withColumn("_median", F.median("energy_per_job_kwh").over(all_rows()))
    return table.withColumn(
        "_mad", F.median(F.abs(F.col("energy_per_job_kwh") - F.col("_median"))).over(all_rows())
    )


def median_mad(by_day: DataFrame) -> DataFrame:
    """Median and median absolute deviation of energy per job, 0 for an empty table."""
    return _with_median_mad(energy_per_job_columns(by_day)).agg(
        F.coalesce(F.max("_median"), F.lit(0.0)).alias("median_kwh"),
        F.coalesce(F.max("_mad"), F.lit(0.0)).alias("mad_kwh"),
    )


def efficiency_anomaly(rolled: DataFrame) -> DataFrame:
    """Flag days with high energy per job that a surge in volume does not explain."""
    spread = F.coalesce(F.nullif("_mad", F.lit(0.0)), F.lit(ANOMALY_MAD_FLOOR))
    high = F.col("energy_per_job_kwh") > F.col("_median") + ANOMALY_MAD_FACTOR * spread
    calm = F.col("job_count") <= F.col("rolling7_job_count") * ANOMALY_VOLUME_FACTOR
    flagged = _with_median_mad(rolled).withColumn(
        "efficiencyAnomaly", high & calm & (F.col("job_count") > 0)
    )
    return flagged.drop("_median", "_mad")


def enrich_by_day(by_day: DataFrame) -> DataFrame:
    """Daily rows with rolling means, peak flags and the efficiency anomaly flag."""
    return sort_by_day(efficiency_anomaly(peak_flags(rolling7(by_day))))


def weekly_average(per_day: DataFrame) -> DataFrame:
    """Mean jobs of consecutive blocks of seven day rows."""
    block = F.floor((F.row_number().over(_by_day()) - 1) / 7)
    return (
        per_day.withColumn("_block", block)
        .groupBy("_block")
        .agg(F.avg("job_count").alias("average_jobs"))
        .select(
            F.concat(F.lit("Week "), (F.col("_block") + 1).cast("string")).alias("week"),
            "average_jobs",
        )
    )


def every_7th_day(per_day: DataFrame) -> DataFrame:
    """Day rows 0, 7, 14 ... of the daily series (a chart's sampled axis)."""
    return (
        per_day.withColumn("_row", F.row_number().over(_by_day()) - 1)
        .where(F.col("_row") % 7 == 0)
        .drop("_row")
    )


def peak_days(per_day: DataFrame) -> DataFrame:
    """First day with the most jobs and first day with the fewest."""
    return per_day.agg(
        F.min(F.struct((-F.col("job_count")).alias("n"), F.col(START_DAY).alias("d"))).alias("most"),
        F.min(F.struct(F.col("job_count").alias("n"), F.col(START_DAY).alias("d"))).alias("least"),
    ).select(
        F.col("most.d").alias("peak_day"),
        (-F.col("most.n")).alias("peak_jobs"),
        F.col("least.d").alias("lowest_day"),
        F.col("least.n").alias("lowest_jobs"),
    )


def day_hour_matrix(by_day_hour: DataFrame) -> DataFrame:
    """Cells of the day x hour matrix with the matrix maxima and each cell's share of them."""
    cells = by_day_hour.groupBy(START_DAY, F.col(START_HOUR).cast("int").alias(START_HOUR)).agg(
        F.sum("job_count").alias("job_count"), F.sum("energy_total_kwh").alias("energy_total_kwh")
    )
    maxima = {
        "max_job_count": F.greatest(F.max("job_count").over(all_rows()), F.lit(0)),
        "max_energy_kwh": F.greatest(F.max("energy_total_kwh").over(all_rows()), F.lit(0.0)),
    }

    def share(value: str, top: str) -> Column:
        return F.coalesce(F.try_divide(F.col(value), F.col(top)), F.lit(0.0))

    return cells.withColumns(maxima).withColumns(
        {
            "job_share": share("job_count", "max_job_count"),
            "energy_share": share("energy_total_kwh", "max_energy_kwh"),
        }
    )


def hour_efficiency(by_hour: DataFrame) -> DataFrame:
    return energy_per_job_columns(by_hour).orderBy(F.col(START_HOUR).cast("int"))


def low_energy_hour_share(by_hour: DataFrame) -> DataFrame:
    """Share of jobs that start in hours whose mean energy is at or below the median hour."""
    median = F.median("energy_mean_kwh").over(all_rows())
    low = F.col("energy_mean_kwh") <= F.col("_median")
    share = F.try_divide(F.sum(F.when(low, F.col("job_count"))) * 100.0, F.sum("job_count"))
    return by_hour.withColumn("_median", median).agg(
        F.coalesce(share, F.lit(0.0)).alias("low_energy_hour_share")
    )
