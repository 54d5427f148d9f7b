"""Sessions of a user: submissions that follow each other without a long pause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def submit_sessions(jobs: DataFrame, user: str = "User", at: str = "Submit", gap_minutes: float = 30) -> DataFrame:
    """(user, session_start, session_end, job_count): runs of events with pauses of at most the gap.

    Events are first counted in slices as long as the gap: whatever lies in one slice belongs to one
    session. Slices combine before the shuffle, so a user with a third of all rows comes down to one
    row per slice and task, and only slices are ordered. Two slices join when the last event of one
    and the first of the next are not farther apart than the gap. Rows without user or time are left
    out; repeats count.
    """
    micros = round(gap_minutes * 60_000_000)
    time = F.unix_micros(F.col(at).cast("timestamp"))
    slices = (
        jobs.where(F.col(user).isNotNull() & F.col(at).isNotNull())
        .select(F.col(user).alias("user"), time.alias("t"))
        .groupBy("user", F.floor(F.col("t") / micros).alias("slice"))
        .agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))
    )
    line = W.partitionBy("user").orderBy("slice")
    opens = F.coalesce(F.col("first") - F.lag("last").over(line) > micros, F.lit(True))
    numbered = slices.withColumn("opens", opens.cast("int")).withColumn(
        "session", F.sum("opens").over(line.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    return numbered.groupBy("user", "session").agg(
        F.timestamp_micros(F.min("first")).alias("session_start"),
        F.timestamp_micros(F.max("last")).alias("session_end"),
        F.sum("n").alias("job_count"),
    ).drop("session")
