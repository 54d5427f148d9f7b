"""Grid carbon intensity: latest reading of a zone, the reading in force at a time, the mean over a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.constants import DEFAULT_INTENSITY, FALLBACK_INTENSITY
from jobmeter.operators.lookups import map_literal, small_side
from jobmeter.session import materialize

INTENSITY = "carbon_intensity_gco2e_per_kwh"


def _fallback(zone: Column) -> Column:
    return F.coalesce(F.try_element_at(map_literal(FALLBACK_INTENSITY), zone), F.lit(DEFAULT_INTENSITY))


def _resolved(reading: Column, zone: Column) -> Column:
    """Value of a reading struct: no reading falls back by zone, a reading without value is 0."""
    value = F.coalesce(F.nanvl(reading["value"], F.lit(None)), F.lit(0.0))
    return F.when(reading.isNull(), _fallback(zone)).otherwise(value)


def _readings(readings: DataFrame) -> DataFrame:
    """One row per zone and time, whatever repeats the source holds."""
    return (
        readings.where("zone is not null and reading_ts is not null")
        .groupBy("zone", F.col("reading_ts").cast("timestamp").alias("ts"))
        .agg(F.max(F.col("carbon_intensity").cast("double")).alias("value"))
    )


def latest_reading(readings: DataFrame) -> DataFrame:
    """Last reading of every zone as a struct (ts, value)."""
    value = F.col("carbon_intensity").cast("double").alias("value")
    return (
        readings.where("zone is not null and reading_ts is not null")
        .groupBy("zone")
        .agg(F.max(F.struct(F.col("reading_ts").cast("timestamp").alias("ts"), value)).alias("_latest"))
    )


def intensity_lookup(df: DataFrame, readings: DataFrame, zone: str = "zone") -> DataFrame:
    """Add the intensity of a row's zone: latest reading, else fallback by zone."""
    latest = small_side(latest_reading(readings).withColumnRenamed("zone", zone))
    return (
        df.join(latest, zone, "left")
        .withColumn(INTENSITY, _resolved(F.col("_latest"), F.col(zone)))
        .drop("_latest")
    )


def validity_intervals(readings: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Closed validity intervals (zone, bucket, ts, next_ts, value), one row per touched bucket.

    The successor of a reading is found inside its day; only the first reading of each day is
    ordered across days, so no task sorts the whole history of a busy zone.
    """
    return _intervals(_readings(readings), bucket_seconds)


def _successors(single: DataFrame) -> DataFrame:
    """Readings with the time of the next one of their zone (null for the last) and their day."""
    single = single.withColumn("_day", F.to_date("ts"))
    next_in_day = F.lead("ts").over(W.partitionBy("zone", "_day").orderBy("ts"))
    next_day = (
        single.groupBy("zone", "_day")
        .agg(F.min("ts").alias("_first"))
        .select(
            "zone", "_day",
            F.lead("_first").over(W.partitionBy("zone").orderBy("_day")).alias("_next_first"),
        )
    )
    return (
        single.withColumn("_next", next_in_day)
        .join(next_day, ["zone", "_day"])
        .withColumn("next_ts", F.coalesce("_next", "_next_first"))
        .drop("_next", "_next_first")
    )


def _buckets(start: Column, end: Column, bucket_seconds: int) -> Column:
    """Numbers of the time buckets that [start, end) touches."""
    micros = F.lit(bucket_seconds * 1_000_000)
    return F.sequence(F.floor(F.unix_micros(start) / micros), F.floor((F.unix_micros(end) - 1) / micros))


def _intervals(single: DataFrame, bucket_seconds: int) -> DataFrame:
    closed = _successors(single).where("next_ts is not null")
    bucket = F.explode(_buckets(F.col("ts"), F.col("next_ts"), bucket_seconds)).alias("bucket")
    return closed.select("zone", bucket, "ts", "next_ts", "value")


def intensity_asof(
    jobs: DataFrame,
    readings: DataFrame,
    zone: str = "zone",
    at: str = "Start",
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Add the intensity in force in a row's zone at its time, with the fallbacks of the lookup.

    An equi-join on (zone, time bucket) with the interval test inside it: intervals do not overlap,
    so each job meets one row at most and keeps its place. Times after a zone's last reading are
    served by the latest-reading table instead of an endless interval.

    The readings are read once, while the plan is built: reduced to one row per zone and time they
    are written to the shared folder, and so are the intervals.
    """
    single = materialize(_readings(readings), "readings")
    intervals = materialize(
        _intervals(single, bucket_seconds)
        .select(
            F.col("zone").alias("_zone"), F.col("bucket").alias("_bucket"), "ts", "next_ts",
            F.struct("ts", "value").alias("_reading"),
        ),
        "intervals",
    )
    latest = single.groupBy(F.col("zone").alias("_last_zone")).agg(F.max(F.struct("ts", "value")).alias("_latest"))
    moment = F.col(at).cast("timestamp")
    bucket = F.floor(F.unix_micros(moment) / F.lit(bucket_seconds * 1_000_000))
    in_force = (
        (F.col(zone) == F.col("_zone"))
        & (F.col("_at_bucket") == F.col("_bucket"))
        & (F.col("ts") <= moment)
        & (moment < F.col("next_ts"))
    )
    reading = F.when(moment >= F.col("_latest.ts"), F.col("_latest")).otherwise(F.col("_reading"))
    return (
        jobs.withColumn("_at_bucket", bucket)
        .join(small_side(intervals), in_force, "left")
        .join(small_side(latest), F.col(zone) == F.col("_last_zone"), "left")
        .withColumn(INTENSITY, _resolved(reading, F.col(zone)))
        .drop("_at_bucket", "_zone", "_bucket", "ts", "next_ts", "_reading", "_last_zone", "_latest")
    )


# Intensities and their integrals over microseconds as exact decimals.
_VALUE, _AREA = "decimal(18,6)", "decimal(38,6)"


def _area(value: Column, start: Column, end: Column) -> Column:
    return (value * (F.unix_micros(end) - F.unix_micros(start)).cast("decimal(19,0)")).cast(_AREA)


def intensity_integral(readings: DataFrame, max_hold_hours: float | None = None) -> DataFrame:
    """(zone, ts, next_ts, value, area): every reading with the integral of its zone up to its time.

    ``area`` is in intensity times microseconds since the zone's first reading, an exact decimal: the
    difference of two of them, late in a long history, has lost nothing. A reading holds until the
    next one, or for ``max_hold_hours`` at most; from then on the zone's fallback holds. A reading
    without a finite value is 0. Sums run inside a day, and one offset per day is added, so no task
    goes through the whole history of a zone.
    """
    value = F.coalesce(F.col("value").try_cast(_VALUE), F.lit(0)).cast(_VALUE)
    single = _readings(readings).select("zone", "ts", value.alias("value"))
    if max_hold_hours is not None:
        # Where a reading stops to hold before the next one, the fallback is a reading of its own.
        stop = F.timestamp_micros(F.unix_micros("ts") + F.lit(round(max_hold_hours * 3.6e9)))
        gaps = _successors(single).where(F.col("next_ts").isNull() | (stop < F.col("next_ts")))
        single = single.unionByName(gaps.select("zone", stop.alias("ts"), _fallback(F.col("zone")).cast(_VALUE).alias("value")))
    held = _successors(single).withColumn("_piece", _area(F.col("value"), F.col("ts"), F.col("next_ts")))
    day = W.partitionBy("zone", "_day").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    days = held.groupBy("zone", "_day").agg(F.sum("_piece").alias("_total"))
    earlier = W.partitionBy("zone").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("zone", "_day", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).cast(_AREA).alias("_before"))
    inside = held.withColumn("_inside", F.coalesce(F.sum("_piece").over(day), F.lit(0)).cast(_AREA))
    return inside.join(days, ["zone", "_day"]).select(
        "zone", "ts", "next_ts", "value", (F.col("_before") + F.col("_inside")).cast(_AREA).alias("area")
    )


def intensity_over_run(
    jobs: DataFrame,
    readings: DataFrame,
    zone: str = "zone",
    start: str = "Start",
    end: str = "End",
    max_hold_hours: float | None = None,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Add the time-weighted intensity of a row's zone between two times.

    The integral of a zone is known at each reading, hence at any time by one as-of look-up, and the
    mean over a run is the difference of two of them over its length: a run of any length is one row
    and meets two rows. Before a zone's first reading, and in zones without any, the fallback holds;
    after the last reading that reading holds (both unless ``max_hold_hours`` ends it). A run without
    length, with one known end only, or that ends before it starts has the intensity at its start
    (else at its end); without both times it has the fallback.

    The readings are read once, while the plan is built, as in ``intensity_asof``.
    """
    integral = materialize(intensity_integral(readings, max_hold_hours), "integral")
    point = F.struct("ts", "value", "area")
    bucket = F.explode(_buckets(F.col("ts"), F.col("next_ts"), bucket_seconds)).alias("_bucket")
    intervals = integral.where("next_ts is not null").select(
        F.col("zone").alias("_zone"), bucket, "ts", "next_ts", point.alias("_point")
    )
    intervals = small_side(materialize(intervals, "intervals"))
    edges = integral.groupBy(F.col("zone").alias("_edge_zone")).agg(
        F.min("ts").alias("_first"), F.max(point).alias("_last")
    )
    known = [F.col(c).cast("timestamp") for c in (start, end)]
    begins = F.coalesce(*known)
    timed = jobs.withColumn("_begins", begins).withColumn(
        "_ends", F.greatest("_begins", F.coalesce(known[1], "_begins"))
    )
    timed = timed.join(small_side(edges), F.col(zone) == F.col("_edge_zone"), "left")
    micros = F.lit(bucket_seconds * 1_000_000)
    for at, found in (("_begins", "_from"), ("_ends", "_to")):
        in_force = (
            (F.col(zone) == F.col("_zone")) & (F.col("_at_bucket") == F.col("_bucket"))
            & (F.col("ts") <= F.col(at)) & (F.col(at) < F.col("next_ts"))
        )
        # Times outside the readings need no look-up: they look for no bucket.
        inside = (F.col(at) >= F.col("_first")) & (F.col(at) < F.col("_last.ts"))
        joined = timed.withColumn("_at_bucket", F.when(inside, F.floor(F.unix_micros(at) / micros))).join(
            intervals, in_force, "left"
        )
        none = F.struct(
            F.col("_first").alias("ts"), _fallback(F.col(zone)).cast(_VALUE).alias("value"),
            F.lit(0).cast(_AREA).alias("area"),
        )
        standing = F.when(F.col(at) >= F.col("_last.ts"), F.col("_last")).otherwise(F.coalesce("_point", none))
        timed = joined.withColumn(found, standing).drop("_at_bucket", "_zone", "_bucket", "ts", "next_ts", "_point")

    def area(found: str, at: str) -> Column:
        return F.col(f"{found}.area") + _area(F.col(f"{found}.value"), F.col(f"{found}.ts"), F.col(at))

    length = F.unix_micros("_ends") - F.unix_micros("_begins")
    mean = (area("_to", "_ends") - area("_from", "_begins")).cast("double") / F.nullif(length, F.lit(0))
    return timed.withColumn(INTENSITY, F.coalesce(mean, F.col("_from.value").cast("double"))).drop("_begins", "_ends", "_edge_zone", "_first", "_last", "_from", "_to")
