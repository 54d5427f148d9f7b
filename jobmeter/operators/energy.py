"""Energy per job and the joins on the job key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.constants import TARGET_COLUMN


def _one_row_per_key(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregate per ``job_key`` so that a later join on the key can still split hot keys.

    The second grouping column depends on the key and changes no group. It only keeps the result
    from being partitioned by the key alone, so the join shuffles this (small, reduced) side once
    more and adaptive execution sees plain shuffles on both sides: with the aggregate directly
    below the join it could not split a key that holds a large share of the jobs.
    """
    return (
        df.where(F.col("job_key").isNotNull())
        .groupBy("job_key", F.length("job_key").alias("_length"))
        .agg(*aggregates)
        .drop("_length")
    )


def energy_per_job(readings: DataFrame) -> DataFrame:
    """Total metered energy per job key; all-null readings give 0, null keys are dropped."""
    energy = F.nanvl(F.col(TARGET_COLUMN).cast("double"), F.lit(None))
    total = F.coalesce(F.sum(energy), F.lit(0.0)).alias(TARGET_COLUMN)
    return _one_row_per_key(readings, total)


def join_features(jobs: DataFrame, energy: DataFrame) -> DataFrame:
    """Inner join on ``job_key``; right-hand name clashes get the suffix ``_em``.

    ``energy`` has one row per key while jobs may repeat a key: every copy carries the full energy.
    """
    clashes = {c: f"{c}_em" for c in energy.columns if c != "job_key" and c in jobs.columns}
    return jobs.join(energy.withColumnsRenamed(clashes), "job_key")


def repeated_job_keys(jobs: DataFrame) -> DataFrame:
    """Job keys carried by more than one accounting row."""
    return _one_row_per_key(jobs, F.count("*").alias("copies")).where("copies > 1")


def merge_predictions(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Features with the prediction of their job key; predictions are reduced to one per key."""
    rest = [c for c in predictions.columns if c != "job_key"]
    single = _one_row_per_key(predictions, F.min(F.struct(*rest)).alias("p")).select("job_key", "p.*")
    clashes = {c: f"{c}_pred" for c in rest if c in features.columns}
    return features.join(single.withColumnsRenamed(clashes), "job_key", "left")
