"""Usage by day and hour, kept up to date from files as they arrive.

Accounting rows and energy readings are two file streams. Jobs are recognised by JobID in the state
store, so that a row that is exported again counts once, and both streams are joined on the job key
with their state kept, so that either side may come first, however late. What a micro-batch adds is
counted in event-time windows of one hour and written as one small table of changes; the current
tables are sums of changes. A refresh therefore costs what the new files cost and nothing is read
again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmeter.constants import MISSING_TEXTS, TARGET_COLUMN
from jobmeter.functions.text import to_numeric
from jobmeter.functions.times import day_text, job_key, utc_timestamp
from jobmeter.operators.usage import START_DAY, START_HOUR

CELL = "start_day string, start_hour int, job_count long, energy_total_kwh double"

#: State in RocksDB, with bounded memory; both sides of a join share a store, and no store outlasts its task.
_STORE = "spark.sql.streaming.stateStore"
ON_DISK = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
    f"{_STORE}.unloadOnCommit": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


class LateRows(RuntimeError):
    """Rows came later than the given delay and Spark left them out."""


def stream_csv(
    spark: SparkSession, folder: str, columns: Iterable[str], sep: str = "|", files_per_batch: int | None = None
) -> DataFrame:
    """The CSV files of a folder as a stream of text columns; files are read once, as they appear.

    All files have the given columns in that order. Texts that stand for a missing value become null.
    """
    columns = list(columns)
    reader = spark.readStream.schema(", ".join(f"`{c}` string" for c in columns))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.csv(folder, sep=sep, header=True, quote='"', escape='"', pathGlobFilter="*.csv")
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c.strip()) for c in columns])


def changes(jobs: DataFrame, readings: DataFrame, delay: str | None = None) -> DataFrame:
    """(at, job_count, energy_total_kwh): what each new row of two streams adds to the hour it belongs to.

    ``jobs`` has JobID, User and Start, ``readings`` job_key and energy_kWh. A job counts when its first
    reading is there; each reading adds its energy to every job of its key. Rows without key never
    meet. Jobs without JobID are told apart by user and start alone.

    Without ``delay`` the state holds all keys and any row may come at any time. With it, state older
    than the newest start less the delay is dropped, and so are rows that come later than that.
    """
    start = utc_timestamp(F.col("Start"))
    keyed = jobs.select(
        F.coalesce("JobID", F.concat(F.lit("?"), job_key(F.col("User"), start))).alias("id"),
        job_key(F.col("User"), start).alias("job_key"), start.alias("at"),
    ).where("job_key is not null")
    kwh = F.nanvl(to_numeric(F.col(TARGET_COLUMN)), F.lit(None))
    metered = readings.where("job_key is not null").select(
        F.col("job_key").alias("key"),
        F.right("job_key", F.lit(19)).try_cast("timestamp").alias("key_at"),
        F.coalesce(kwh, F.lit(0.0)).alias("kwh"),
    )
    same = F.col("job_key") == F.col("key")
    if delay:
        # Jobs and readings of a key have one time, to the second; as a join key it lets old state go.
        keyed = keyed.withColumn("at", F.date_trunc("second", "at")).withWatermark("at", delay)
        metered = metered.where("key_at is not null").withWatermark("key_at", delay)
        keyed = keyed.dropDuplicatesWithinWatermark(["id"])
        first = metered.dropDuplicatesWithinWatermark(["key"])
        same &= F.col("at") == F.col("key_at")
    else:
        keyed = keyed.dropDuplicates(["id"])
        first = metered.dropDuplicates(["key"])
    # Marks and readings meet the jobs in one join, so the jobs are in the state once.
    marks = first.select("key", "key_at", F.lit(1).cast("long").alias("job_count"), F.lit(0.0).alias("energy_total_kwh"))
    added = metered.select("key", "key_at", F.lit(0).cast("long").alias("job_count"), F.col("kwh").alias("energy_total_kwh"))
    return keyed.join(added.unionByName(marks), same).select("at", "job_count", "energy_total_kwh")


def _write(table: str) -> Callable[[DataFrame, int], None]:
    """Write a micro-batch as its own folder; when it is run again after a failure, the folder is replaced."""

    def write(rows: DataFrame, batch: int) -> None:
        hour = F.window("at", "1 hour")["start"]
        cells = rows.groupBy(hour.alias("hour")).agg(
            F.sum("job_count").alias("job_count"), F.sum("energy_total_kwh").alias("energy_total_kwh")
        )
        cells.select(
            day_text(F.to_date("hour")).alias(START_DAY), F.hour("hour").alias(START_HOUR), "job_count", "energy_total_kwh"
        ).write.mode("overwrite").parquet(f"{table}/changes/batch={batch}")

    return write


@contextmanager
def _settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def refresh(
    jobs: DataFrame, readings: DataFrame, table: str, *, delay: str | None = None, partitions: int | None = None,
    on_disk: bool = False,
) -> int:
    """Take all new files of both streams into ``table`` and stop; the number of rows read.

    ``table`` is a folder that every executor can reach; state, offsets and changes live there, and the
    next call goes on from them. ``partitions`` sets the number of state partitions at the first call.
    ``on_disk`` keeps the state in files of the executors with a bounded amount of memory, for state that
    does not fit their heaps. It and ``delay`` must be the same in every call. If rows came later than it allows, ``LateRows`` says how
    many; nothing is lost silently.
    """
    spark = jobs.sparkSession
    settings = {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}
    with _settings(spark, settings | (ON_DISK if on_disk else {})):
        stream = (
            changes(jobs, readings, delay).writeStream.foreachBatch(_write(table))
            .option("checkpointLocation", f"{table}/state").trigger(availableNow=True).start()
        )
        stream.awaitTermination()
    progress = stream.recentProgress
    late = sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
    if late:
        raise LateRows(f"{late} rows came more than {delay} after the newest start")
    return sum(p.numInputRows for p in progress)


def day_hours(spark: SparkSession, table: str) -> DataFrame:
    """Sparse (start_day, start_hour) cells with jobs and energy, as of the last refresh."""
    changed = spark.read.schema(CELL + ", batch long").parquet(f"{table}/changes")
    return changed.groupBy(START_DAY, START_HOUR).agg(
        F.sum("job_count").alias("job_count"), F.sum("energy_total_kwh").alias("energy_total_kwh")
    ).where("job_count > 0")


def _totals(cells: DataFrame, key: str) -> DataFrame:
    total, jobs = F.sum("energy_total_kwh"), F.sum("job_count")
    return cells.groupBy(key).agg(
        jobs.alias("job_count"), total.alias("energy_total_kwh"), (total / jobs).alias("energy_mean_kwh")
    )


def by_day(spark: SparkSession, table: str) -> DataFrame:
    """Jobs and energy per start day, as of the last refresh."""
    return _totals(day_hours(spark, table), START_DAY)


def by_hour_of_day(spark: SparkSession, table: str) -> DataFrame:
    """Jobs and energy per start hour, as of the last refresh."""
    return _totals(day_hours(spark, table), START_HOUR)


def compact(spark: SparkSession, table: str, copy_to: str) -> None:
    """Write the current cells as one table, for readers that come often."""
    day_hours(spark, table).coalesce(1).write.mode("overwrite").parquet(copy_to)
