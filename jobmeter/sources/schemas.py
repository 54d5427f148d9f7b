"""Declared schemas of the JSON documents."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()

FORECAST_REQUEST = _struct(
    sbatchText=_TEXT,
    parameters=_struct(
        partitionName=_TEXT, nodeCount=_LONG, cpuCores=_LONG, gpuCount=_LONG,
        memoryGigabytes=_DOUBLE, walltimeHours=_DOUBLE,
    ),
    zone=_TEXT,
)

SUMMARY_STATS = _struct(
    count=_LONG, min=_DOUBLE, max=_DOUBLE, mean=_DOUBLE, median=_DOUBLE, p95=_DOUBLE
)

_ENERGY = {"job_count": _LONG, "energy_total_kwh": _DOUBLE, "energy_mean_kwh": _DOUBLE}
_WAITS = {"queue_wait_time_hours_mean": _DOUBLE, "requested_walltime_hours_mean": _DOUBLE}


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(_struct(**fields))


_PER_TABLE = _struct(
    features=T.MapType(_TEXT, _TEXT), predictions=T.MapType(_TEXT, _TEXT),
    merged_records=T.MapType(_TEXT, _TEXT),
)
_MISSING = _struct(
    features=T.MapType(_TEXT, _LONG), predictions=T.MapType(_TEXT, _LONG),
    merged_records=T.MapType(_TEXT, _LONG),
)

INSIGHTS = _struct(
    generated_at_utc=_TEXT,
    units=_struct(energy=_TEXT, duration=_TEXT, timestamps=_TEXT, counts=_TEXT),
    schema=_PER_TABLE,
    missingness=_MISSING,
    dataset=_struct(
        job_count=_LONG, unique_users=_LONG, time_range=_struct(start=_TEXT, end=_TEXT),
        energy_kwh=SUMMARY_STATS, requested_walltime_hours=SUMMARY_STATS,
        queue_wait_time_hours=SUMMARY_STATS,
    ),
    job_type_breakdown=_rows(job_type=_TEXT, **_ENERGY),
    top_users_by_energy=_rows(user=_TEXT, energy_total_kwh=_DOUBLE),
    aggregations=_struct(
        by_user=_rows(user=_TEXT, **_ENERGY, **_WAITS),
        by_account=_rows(account=_TEXT, **_ENERGY, **_WAITS),
        by_state=_rows(state=_TEXT, **_ENERGY, **_WAITS),
        by_job_type=_rows(job_type=_TEXT, **_ENERGY, **_WAITS),
        by_day=_rows(start_day=_TEXT, **_ENERGY),
        by_hour_of_day=_rows(start_hour=_TEXT, **_ENERGY),
        by_day_hour=_rows(
            start_day=_TEXT, start_hour=_TEXT, job_count=_LONG, energy_total_kwh=_DOUBLE
        ),
    ),
    distributions=_struct(
        numeric=T.MapType(_TEXT, SUMMARY_STATS),
        categorical=T.MapType(_TEXT, T.MapType(_TEXT, _LONG)),
    ),
)
