"""Energy and emissions of job requests, and of jobs that already ran."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.functions import power, text
from jobmeter.functions.times import day_text
from jobmeter.operators.carbon import INTENSITY, intensity_asof, intensity_lookup, intensity_over_run
from jobmeter.operators.lookups import zone_lookup
from jobmeter.operators.scripts import parse_sbatch, total_cores, total_memory_gb

INPUTS = ("cpu_cores", "gpu_count", "node_count", "partition_name", "memory_gigabytes", "walltime_hours")


def resolve_request(
    requests: DataFrame,
    mapping: Mapping[str, str] | DataFrame | None = None,
    mem_per_cpu_fix: bool = False,
) -> DataFrame:
    """Explicit parameters over script directives over defaults; 0 is a value, not a gap.

    ``requests`` has sbatchText, parameters (struct) and zone. The result replaces them by the
    resolved inputs and the zone; an empty zone counts as missing.
    """
    parsed = parse_sbatch(requests)
    given = F.col("parameters")
    cores = F.coalesce(given["cpuCores"], total_cores(), F.lit(1)).cast("long")
    prefix = text.node_prefix(F.col("nodelist"))
    resolved = parsed.withColumn("_prefix", prefix).withColumn("cpu_cores", cores)
    resolved = zone_lookup(resolved, "_prefix", mapping, "_node_zone")
    memory = total_memory_gb(F.col("cpu_cores"), mem_per_cpu_fix)
    kept = [c for c in requests.columns if c not in ("sbatchText", "parameters", "zone")]
    return resolved.select(
        *kept,
        "cpu_cores",
        F.coalesce(given["gpuCount"], "gpu_count", F.lit(0)).cast("long").alias("gpu_count"),
        F.coalesce(given["nodeCount"], "node_count").cast("long").alias("node_count"),
        F.coalesce(given["partitionName"], "partition_name").alias("partition_name"),
        F.coalesce(given["memoryGigabytes"], memory, F.lit(0.0)).alias("memory_gigabytes"),
        F.coalesce(given["walltimeHours"], "walltime_hours", F.lit(1.0)).alias("walltime_hours"),
        F.coalesce(F.nullif("zone", F.lit("")), "_node_zone").alias("zone"),
    )


def _estimate(df: DataFrame, cores: Column, memory_gb: Column, hours: Column) -> DataFrame:
    """Power, energy and emissions under the row's carbon intensity."""
    return (
        df.withColumn("power_watts", power.power_watts(cores, memory_gb))
        .withColumn("energy_kwh", power.energy_kwh(F.col("power_watts"), hours))
        .withColumn("emissions_gco2e", power.emissions_gco2e(F.col("energy_kwh"), F.col(INTENSITY)))
        .withColumn("emissions_kgco2e", power.emissions_kgco2e(F.col("emissions_gco2e")))
    )


def forecast_batch(
    requests: DataFrame,
    readings: DataFrame,
    mapping: Mapping[str, str] | DataFrame | None = None,
    mem_per_cpu_fix: bool = False,
) -> DataFrame:
    """Forecast of every request, with its resolved inputs as a struct and its notes as an array.

    Where ``requests`` has a column ``error``, rows with an error keep it and have no forecast.
    """
    resolved = intensity_lookup(resolve_request(requests, mapping, mem_per_cpu_fix), readings)
    estimated = _estimate(
        resolved, F.col("cpu_cores"), F.col("memory_gigabytes"), F.col("walltime_hours")
    )
    kept = [c for c in requests.columns if c not in ("sbatchText", "parameters", "zone")]
    results = {c: F.col(c) for c in ("energy_kwh", "emissions_kgco2e", "emissions_gco2e", "power_watts", INTENSITY, "zone")}
    results |= {"inputs": F.struct(*INPUTS), "notes": power.forecast_notes(F.col("gpu_count"))}
    good = F.col("error").isNull() if "error" in kept else F.lit(True)
    return estimated.select(*kept, *[F.when(good, value).alias(c) for c, value in results.items()])


def estimate_jobs(jobs: DataFrame, readings: DataFrame, zone: str = "zone", whole_run: bool = False) -> DataFrame:
    """The same model over jobs that ran: allocated cores and memory, real hours, intensity then.

    The intensity is that at the start, or with ``whole_run`` the mean over the job's whole run.
    """
    look_up = intensity_over_run if whole_run else intensity_asof
    timed = look_up(jobs, readings, zone)
    return _estimate(
        timed, F.col("alloc_cpu"), F.col("alloc_mem_gb"), F.col("requested_walltime_hours")
    )


def job_emissions(jobs: DataFrame, readings: DataFrame, zone: str = "zone", whole_run: bool = False) -> DataFrame:
    """Modelled energy and emissions per user and start day."""
    return (
        estimate_jobs(jobs, readings, zone, whole_run)
        .where("User is not null and Start is not null")
        .groupBy(F.col("User").alias("user"), F.to_date("Start").alias("start_day"))
        .agg(
            F.count("*").alias("job_count"),
            F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("energy_kwh"),
            F.coalesce(F.sum("emissions_gco2e"), F.lit(0.0)).alias("emissions_gco2e"),
        )
        .withColumn("start_day", day_text(F.col("start_day")))
    )

