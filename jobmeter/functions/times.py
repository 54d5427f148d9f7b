"""Timestamps, durations and calendar parts, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Tried in order after the ISO forms; a text is read by the first that fits it as a whole.
OTHER_FORMATS = (
    "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "MMM d yyyy HH:mm:ss",
    "MMM d yyyy", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy", "yyyyMMdd HH:mm:ss", "yyyyMMdd",
)


def utc_timestamp(column: Column) -> Column:
    """Mixed-format text (or a timestamp) to a timestamp; unreadable text becomes null."""
    text = F.trim(column.cast("string"))
    return F.coalesce(
        F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in OTHER_FORMATS]
    )


def unreadable(column: Column) -> Column:
    """Whether there is a text that is no timestamp; sum it up to count what a load loses."""
    text = column.cast("string")
    return F.coalesce(utc_timestamp(column).isNull() & (F.trim(text) != ""), F.lit(False))


def strict_utc_timestamp(column: Column) -> Column:
    """As ``utc_timestamp``, but unreadable text fails the job; empty text is missing."""
    parsed = utc_timestamp(column)
    text = column.cast("string")
    message = F.concat(F.lit("unreadable timestamp: "), text)
    return F.when(
        parsed.isNull() & text.isNotNull() & (text != ""), F.raise_error(message).cast("timestamp")
    ).otherwise(parsed)


def hours_between(start: Column, end: Column) -> Column:
    """Signed difference in hours, fractions of a second included."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def day_text(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def second_text(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def job_key(user: Column, start: Column) -> Column:
    """``user_YYYY-MM-DD HH:MM:SS``; null without a user or a start."""
    return F.when((user != "") & start.isNotNull(), F.concat_ws("_", user, second_text(start)))


def pacific_time(text: Column) -> Column:
    """A UTC instant as US Pacific wall-clock text; unreadable text is passed through."""
    utc = utc_timestamp(text)
    local = F.from_utc_timestamp(utc, "America/Los_Angeles")
    abbreviation = F.when(hours_between(local, utc) == 7, F.lit("PDT")).otherwise(F.lit("PST"))
    shown = F.concat_ws(" ", F.date_format(local, "MMM d, yyyy, h:mm:ss a"), abbreviation)
    return F.when(utc.isNull(), text).otherwise(shown)


def runtime_method(df: DataFrame) -> str | None:
    """Which columns give a job's duration; names are matched exactly."""
    if {"START", "End"} <= set(df.columns):
        return "START_End"
    return "Elapsed" if "Elapsed" in df.columns else None


def runtime_hours(df: DataFrame) -> Column:
    """Duration in hours from START and End when both exist, else from Elapsed seconds."""
    method = runtime_method(df)
    if method == "START_End":
        return hours_between(strict_utc_timestamp(df["START"]), strict_utc_timestamp(df["End"]))
    if method == "Elapsed":
        return df["Elapsed"].cast("double") / F.lit(3600.0)
    return F.lit(None).cast("double")
