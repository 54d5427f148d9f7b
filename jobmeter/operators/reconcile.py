"""Rows of two tables that find no partner: jobs without readings and readings without jobs.

A Bloom filter over the keys of the smaller side tells below the shuffle which rows of the larger
side surely have no partner. Only the others go into the exact anti joins, so what is shuffled is
about the matched part of the larger side and not all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.session import materialize

HASHES = 4
BITS_PER_KEY = 10
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 26  # 8 MB at most; beyond that the filter only passes more rows


def _positions(key: Column, bits: int) -> list[Column]:
    """Places of a key: two hashes give all of them."""
    first, step = (F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(2))
    return [(first + F.lit(i) * step) % bits for i in range(HASHES)]


def bloom_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row with the ``bits`` of a Bloom filter over a column as an array of 64-bit words."""
    places = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(F.col(key), bits))).alias("p"))
    set_ = places.select(F.floor(F.col("p") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("mask"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = set_.unionByName(empty).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    ordered = F.sort_array(F.collect_list(F.struct("word", "mask")))
    return words.agg(F.transform(ordered, lambda w: w["mask"]).alias("bits"))


def may_contain(bits: Column, key: Column, size: int) -> Column:
    """Whether a key may be among those of the filter; false is certain, and so it is for null."""
    tests = [
        F.getbit(F.get(bits, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in _positions(key, size)
    ]
    found = tests[0]
    for test in tests[1:]:
        found = found & test
    return key.isNotNull() & found


def unmatched(
    left: DataFrame, right: DataFrame, key: str = "job_key", bits_per_key: int = BITS_PER_KEY
) -> tuple[DataFrame, DataFrame]:
    """(rows of ``left`` without a partner in ``right``, rows of ``right`` without one in ``left``).

    A null key has no partner. Rows keep all their columns and repeats. Both tables are counted and the
    filter is written once, while the plan is built.
    """
    sizes = [df.where(F.col(key).isNotNull()).count() for df in (left, right)]
    swapped = sizes[0] > sizes[1]
    small, large = (right, left) if swapped else (left, right)
    wanted = max(min(sizes) * bits_per_key, LEAST_BITS)
    size = min(1 << (wanted - 1).bit_length(), MOST_BITS)
    filter_ = materialize(bloom_bits(small.select(key), key, size), "bloom").select("bits").scalar()
    possible = may_contain(filter_, F.col(key), size)
    keys = lambda df: df.select(F.col(key).alias("_partner")).where("_partner is not null")
    meets = F.col(key) == F.col("_partner")
    never = large.where(~possible)
    maybe = large.where(possible)
    large_alone = never.unionByName(maybe.join(keys(small), meets, "left_anti"))
    small_alone = small.join(keys(maybe), meets, "left_anti")
    return (large_alone, small_alone) if swapped else (small_alone, large_alone)


def unmatched_report(jobs: DataFrame, readings: DataFrame) -> DataFrame:
    """(side, job_key, row_count, energy_kwh): unmatched jobs and readings per key; energy is the readings'.

    Both tables are read once, while the plan is built: their keys (and energies) are written first.
    """
    jobs = materialize(jobs.select("job_key"), "keys")
    readings = materialize(readings.select("job_key", "energy_kWh"), "keys")
    jobs_alone, readings_alone = unmatched(jobs, readings)
    kwh = F.nanvl(F.col("energy_kWh").cast("double"), F.lit(None))
    left = jobs_alone.groupBy("job_key").agg(F.count("*").alias("row_count"), F.lit(0.0).alias("energy_kwh"))
    right = readings_alone.groupBy("job_key").agg(
        F.count("*").alias("row_count"), F.coalesce(F.sum(kwh), F.lit(0.0)).alias("energy_kwh")
    )
    return left.select(F.lit("job").alias("side"), "*").unionByName(right.select(F.lit("reading").alias("side"), "*"))
