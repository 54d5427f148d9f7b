"""Accounting rows to the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.constants import CATEGORICAL_COLUMNS, FEATURE_COLUMNS, LEAK_COLUMN, TARGET_COLUMN
from jobmeter.functions import text, times
from jobmeter.operators.energy import energy_per_job, join_features
from jobmeter.operators.lookups import label_encode


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def parse_times(sacct: DataFrame) -> DataFrame:
    """Submit, Start and End as UTC timestamps; unreadable or absent ones are null."""
    return sacct.withColumns(
        {c: times.utc_timestamp(_text(sacct, c)) for c in ("Submit", "Start", "End")}
    )


def with_job_key(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("job_key", times.job_key(_text(parsed, "User"), F.col("Start")))


def with_resources(sacct: DataFrame) -> DataFrame:
    """Allocated cores, memory and GPUs, requested memory and job type."""
    tres = _text(sacct, "AllocTRES")
    return sacct.withColumns(
        {
            "alloc_cpu": text.allocated_cpu(tres),
            "alloc_mem_gb": text.allocated_memory_gb(tres),
            "alloc_gpu": text.allocated_gpu(tres),
            "req_mem_gb": text.requested_memory_gb(_text(sacct, "ReqMem")),
            "is_gpu_job": text.is_gpu_job(tres),
            "job_type": text.job_type(text.is_gpu_job(tres)),
        }
    )


def with_time_features(parsed: DataFrame) -> DataFrame:
    """Queue wait, start to end (called requested walltime), and calendar parts of the start."""
    start = F.col("Start")
    return parsed.withColumns(
        {
            "requested_walltime_hours": times.hours_between(start, F.col("End")),
            "queue_wait_time_hours": times.hours_between(F.col("Submit"), start),
            "hour_of_day": F.hour(start),
            "day_of_week": F.weekday(start),
        }
    )


def job_features(sacct: DataFrame) -> DataFrame:
    """All per-job columns: one projection, no shuffle."""
    return with_time_features(with_resources(with_job_key(parse_times(sacct))))


def filter_target(features: DataFrame, target: str = TARGET_COLUMN) -> DataFrame:
    return features.where(F.col(target).isNotNull())


def feature_table(sacct: DataFrame, emissions: DataFrame) -> DataFrame:
    """Accounting rows joined with their metered energy."""
    return filter_target(join_features(job_features(sacct), energy_per_job(emissions)))


def select_features(features: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Model columns that exist, in their order, then target, key and group; the leak column goes."""
    wanted = [*FEATURE_COLUMNS, TARGET_COLUMN, "job_key", "User", *extra]
    columns = [c for c in dict.fromkeys(wanted) if c in features.columns]
    return features.drop(LEAK_COLUMN).select(*columns)


def to_numeric(data: DataFrame) -> DataFrame:
    """Feature columns as doubles; unreadable text becomes null, flags become 0 and 1."""
    types = dict(data.dtypes)
    numeric = {
        c: text.to_numeric(F.col(c)) if types[c] == "string" else F.col(c).cast("double")
        for c in FEATURE_COLUMNS
        if c in types
    }
    return data.withColumns(numeric)


def model_inputs(features: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Selected, label-encoded, numeric model table with a known target."""
    return filter_target(to_numeric(label_encode(select_features(features, extra), CATEGORICAL_COLUMNS)))
