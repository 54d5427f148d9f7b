"""Linear power model: watts, energy and emissions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmeter.constants import GPU_NOTE, WATTS_PER_CORE, WATTS_PER_GB


def power_watts(cores: Column, memory_gb: Column) -> Column:
    return cores * F.lit(WATTS_PER_CORE) + memory_gb * F.lit(WATTS_PER_GB)


def energy_kwh(watts: Column, hours: Column) -> Column:
    return watts * hours / F.lit(1000.0)


def emissions_gco2e(kwh: Column, intensity: Column) -> Column:
    return kwh * intensity


def emissions_kgco2e(grams: Column) -> Column:
    return grams / F.lit(1000.0)


def forecast_notes(gpu_count: Column) -> Column:
    """Array of remarks on a forecast; empty when there is nothing to say."""
    none = F.array().cast("array<string>")
    return F.when(gpu_count > 0, F.array(F.lit(GPU_NOTE))).otherwise(none)
