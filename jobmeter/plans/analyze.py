"""Usage report over flat accounting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.functions import times
from jobmeter.operators import daily, reports
from jobmeter.operators.describe import describe, summarize
from jobmeter.operators.ranking import top_k, value_counts, with_shares, with_totals
from jobmeter.operators.usage import START_DAY
from jobmeter.session import materialize

REPORTED_COLUMNS = ("START", "End", "Elapsed", "NCPUS", "State")


def _has(df: DataFrame, *columns: str) -> bool:
    """Exact, case-sensitive column test."""
    return set(columns) <= set(df.columns)


def with_runtime(jobs: DataFrame) -> DataFrame:
    """Add hours from START and End, else from Elapsed (null without either)."""
    return jobs.withColumn("hours", times.runtime_hours(jobs))


def with_cpu_hours(jobs: DataFrame) -> DataFrame:
    """Add hours and cores x hours; only START and End give core hours."""
    if times.runtime_method(jobs) != "START_End" or not _has(jobs, "NCPUS"):
        raise ValueError("core hours need the columns START, End and NCPUS")
    return with_runtime(jobs).withColumn("cpu_hours", F.col("hours") * F.col("NCPUS"))


def metadata(jobs: DataFrame) -> DataFrame:
    """Row count and which of the reported columns exist."""
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        *[F.lit(_has(jobs, c)).alias(f"has_{c.lower()}") for c in REPORTED_COLUMNS],
    )


def runtime_describe(jobs: DataFrame, exact: bool = True) -> DataFrame:
    method = times.runtime_method(jobs)
    table = with_runtime(jobs)
    return describe(table, {"hours": F.col("hours")}, exact).withColumn("method", F.lit(method))


def ncpus_describe(jobs: DataFrame, exact: bool = True) -> DataFrame:
    return describe(jobs, {"NCPUS": F.col("NCPUS")}, exact)


def gpu_describe(jobs: DataFrame, exact: bool = True) -> DataFrame:
    return describe(jobs, {"NGPUs": F.col("NGPUs")}, exact)


def _day_source(jobs: DataFrame) -> tuple[Column, Column]:
    """Timestamp that dates a job, and whether a row spoils the section.

    START is parsed strictly and fails the job; Submit, its stand-in, only empties the section.
    """
    if times.runtime_method(jobs) == "START_End":
        return times.strict_utc_timestamp(F.col("START")), F.lit(False)
    parsed = times.utc_timestamp(F.col("Submit"))
    text = F.col("Submit").cast("string")
    return parsed, parsed.isNull() & text.isNotNull() & (text != "")


def _days(jobs: DataFrame) -> DataFrame:
    """Per day (null for undated rows): rows, earliest and latest time, rows that spoil it."""
    moment, bad = _day_source(jobs)
    return (
        jobs.select(moment.alias("_at"), bad.alias("_bad"))
        .groupBy(F.to_date("_at").alias(START_DAY))
        .agg(*_day_columns(F.col("_at"), F.col("_bad")))
        .withColumn(START_DAY, times.day_text(F.col(START_DAY)))
    )


def jobs_per_day(jobs: DataFrame) -> DataFrame:
    """Jobs per day and the average over days with jobs; the average counts undated rows too."""
    return _daily_patterns(_days(jobs))


def _daily_patterns(days: DataFrame) -> DataFrame:
    whole = daily.all_rows()
    days = days.withColumns(
        {
            "_all": F.sum("job_count").over(whole),
            "_with": F.count_if(F.col("_dated") > 0).over(whole),
            "_bad": F.sum("_spoilt").over(whole),
        }
    )
    return days.where((F.col("_dated") > 0) & (F.col("_bad") == 0)).select(
        START_DAY, "job_count", (F.col("_all") / F.col("_with")).alias("average_jobs_per_day")
    )


def date_range(jobs: DataFrame) -> DataFrame:
    """First and last time and the number of days with jobs."""
    return _range(_days(jobs))


def _range(days: DataFrame) -> DataFrame:
    return (
        days.agg(
            F.min("_first").alias("_first"),
            F.max("_last").alias("_last"),
            F.count_if(F.col("_dated") > 0).alias("total_days"),
            F.sum("_spoilt").alias("_bad"),
        )
        .where("total_days > 0 and _bad = 0")
        .select(
            F.date_format("_first", "yyyy-MM-dd'T'HH:mm:ss").alias("range_start"),
            F.date_format("_last", "yyyy-MM-dd'T'HH:mm:ss").alias("range_end"),
            "total_days",
        )
    )


def cpu_hours_total(jobs: DataFrame) -> DataFrame:
    """Sum of core hours and its average over all rows."""
    total = F.coalesce(F.sum("cpu_hours"), F.lit(0.0))
    return with_cpu_hours(jobs).agg(
        total.alias("total"), F.try_divide(total, F.count("*")).alias("average_per_job")
    )


def cpu_efficiency(jobs: DataFrame) -> DataFrame:
    """Core hours per job as a share of a day, in percent; a rough figure that may exceed 100."""
    return cpu_hours_total(jobs).select(
        (F.col("average_per_job") / 24.0 * 100.0).alias("cpu_efficiency")
    )


def state_counts(jobs: DataFrame) -> DataFrame:
    return value_counts(jobs, "State", share_digits=2)


def partition_counts(jobs: DataFrame) -> DataFrame:
    return value_counts(jobs, "Partition")


def user_counts(jobs: DataFrame) -> DataFrame:
    return value_counts(jobs, "hashed_user")


def top_users(jobs: DataFrame, k: int = 20) -> DataFrame:
    return top_k(user_counts(jobs), "job_count", "hashed_user", k)


def gpu_job_share(jobs: DataFrame) -> DataFrame:
    """Jobs with and without GPUs; a missing GPU count is a job without."""
    with_gpu = F.count_if(F.col("NGPUs") > 0)
    return jobs.agg(
        with_gpu.alias("gpu_jobs"),
        F.try_divide(with_gpu * 100.0, F.count("*")).alias("gpu_percentage"),
        (F.count("*") - with_gpu).alias("cpu_only_jobs"),
    )


def outcome_rates(jobs: DataFrame) -> DataFrame:
    return reports.outcome_rates(state_counts(jobs))


def runtime_histogram(jobs: DataFrame) -> DataFrame:
    return reports.runtime_histogram(with_runtime(jobs), F.col("hours"))


def cpu_histogram(jobs: DataFrame) -> DataFrame:
    return reports.cpu_histogram(jobs, F.col("NCPUS"))


def duration_classes(jobs: DataFrame) -> DataFrame:
    return reports.duration_classes(with_runtime(jobs), F.col("hours"))


def runtime_p95(jobs: DataFrame, exact: bool = True) -> DataFrame:
    stats = summarize(with_runtime(jobs), {"hours": F.col("hours")}, (0.95,), exact)
    return reports.runtime_p95(stats.withColumn("p95", F.col("quantiles")[0]))


def user_activity(jobs: DataFrame) -> DataFrame:
    return reports.user_activity(with_totals(jobs, "hashed_user"))


def user_share(jobs: DataFrame) -> DataFrame:
    return reports.user_share(with_totals(jobs, "hashed_user"), "hashed_user")


def peak_days(jobs: DataFrame) -> DataFrame:
    return daily.peak_days(jobs_per_day(jobs))


def _day_columns(moment: Column, bad: Column) -> list[Column]:
    return [
        F.count("*").alias("job_count"),
        F.min(moment).alias("_first"),
        F.max(moment).alias("_last"),
        F.count_if(bad).alias("_spoilt"),
        F.count(moment).alias("_dated"),
    ]


def group_counts(jobs: DataFrame) -> DataFrame:
    """Rows per day, state, partition and user in one pass (grouping sets), missing groups included.

    ``_set`` names the grouping; the result has one row per group.
    """
    keys = {c: F.col(c).cast("string") for c in ("State", "Partition", "hashed_user") if _has(jobs, c)}
    moment, bad = F.lit(None).cast("timestamp"), F.lit(False)
    if _dated(jobs):
        moment, bad = _day_source(jobs)
        keys[START_DAY] = F.to_date(moment)
    keyed = jobs.select(
        *[c.alias(k) for k, c in keys.items()], moment.alias("_at"), bad.alias("_bad")
    )
    mask = F.grouping_id(*keys)
    names = list(keys)
    label = F.coalesce(
        *[
            F.when(mask == (1 << len(names)) - 1 - (1 << (len(names) - 1 - i)), F.lit(k))
            for i, k in enumerate(names)
        ]
    )
    sets = [[F.col(k)] for k in names]
    return keyed.groupingSets(sets, *[F.col(k) for k in names]).agg(
        label.alias("_set"), *_day_columns(F.col("_at"), F.col("_bad"))
    )


def _dated(jobs: DataFrame) -> bool:
    method = times.runtime_method(jobs)
    return method == "START_End" or (method == "Elapsed" and _has(jobs, "Submit"))


def analyze_jobs(jobs: DataFrame, exact: bool = True) -> dict[str, DataFrame]:
    """Every section that the present columns allow.

    The rows are read by one pass for all totals, one for all counts by group, and the passes of
    ``describe`` for all distributions together. The totals and counts are written to the shared
    folder (they have one row, and one row per group), and the sections are views of them.
    """
    method = times.runtime_method(jobs)
    core_hours = method == "START_End" and _has(jobs, "NCPUS")
    timed = with_runtime(jobs)

    # Totals.
    with_gpu = F.count_if(F.col("NGPUs") > 0) if _has(jobs, "NGPUs") else F.lit(0)
    spent = F.sum(F.col("hours") * F.col("NCPUS")) if core_hours else F.lit(0.0)
    totals = materialize(
        timed.agg(
            F.count("*").alias("total_jobs"),
            F.coalesce(spent, F.lit(0.0)).alias("total"),
            with_gpu.cast("long").alias("gpu_jobs"),
        ),
        "totals",
    )
    flags = [F.lit(_has(jobs, c)).alias(f"has_{c.lower()}") for c in REPORTED_COLUMNS]
    sections = {"metadata": totals.select("total_jobs", *flags)}
    if core_hours:
        average = F.try_divide(F.col("total"), F.col("total_jobs"))
        sections["cpu_hours"] = totals.select("total", average.alias("average_per_job"))
    if _has(jobs, "NGPUs"):
        sections["gpu_jobs"] = totals.select(
            "gpu_jobs",
            F.try_divide(F.col("gpu_jobs") * 100.0, F.col("total_jobs")).alias("gpu_percentage"),
            (F.col("total_jobs") - F.col("gpu_jobs")).alias("cpu_only_jobs"),
        )

    # Distributions.
    measured = {c: F.col(c) for c in ("NCPUS", "NGPUs") if _has(jobs, c)}
    if method is not None:
        measured["hours"] = F.col("hours")
    if measured:
        stats = describe(timed, measured, exact)
        if method is not None:
            sections["runtime_analysis"] = stats.where("metric = 'hours'").withColumn(
                "method", F.lit(method)
            )
        for c, section in (("NCPUS", "cpu_cores"), ("NGPUs", "gpu_statistics")):
            if c in measured:
                sections[section] = stats.where(F.col("metric") == c)

    # Counts by group.
    grouped = {"State": "job_states", "Partition": "partition_analysis", "hashed_user": "user_analysis"}
    present = [c for c in grouped if _has(jobs, c)]
    if present or _dated(jobs):
        counts = materialize(group_counts(jobs), "counts")
        for c in present:
            known = F.when(F.col(c).isNotNull(), F.col("job_count")).otherwise(F.lit(0))
            counted = counts.where(F.col("_set") == c).select(c, "job_count", known.alias("known"))
            shares = with_shares(counted, c, share_digits=2 if c == "State" else None)
            sections[grouped[c]] = top_k(shares, "job_count", c, 20) if c == "hashed_user" else shares
        if _dated(jobs):
            days = counts.where(F.col("_set") == START_DAY)
            days = days.withColumn(START_DAY, times.day_text(F.col(START_DAY)))
            sections["date_range"] = _range(days)
            sections["daily_patterns"] = _daily_patterns(days)
    return sections


def text_summary(sections: dict[str, DataFrame]) -> DataFrame:
    """Headline (position, metric, value) rows as text, from the sections of ``analyze_jobs``."""
    def line(position: int, name: str, value: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"), F.lit(name).alias("metric"),
            value.cast("string").alias("value"),
        )

    def fixed(value: Column, digits: int) -> Column:
        return F.format_string(f"%.{digits}f", value.cast("double"))

    span = F.concat_ws(" to ", F.substring("range_start", 1, 10), F.substring("range_end", 1, 10))
    wanted = {
        "metadata": [line(0, "Total Jobs", F.col("total_jobs"))],
        "date_range": [line(1, "Date Range", span), line(2, "Total Days", F.col("total_days"))],
        "daily_patterns": [line(3, "Average Jobs per Day", fixed(F.col("average_jobs_per_day"), 1))],
        "runtime_analysis": [
            line(4, "Average Duration", fixed(F.col("mean"), 2)),
            line(5, "Median Duration", fixed(F.col("p50"), 2)),
        ],
        "job_states": [line(6, "Success Rate", fixed(F.col("percentage"), 1))],
        "cpu_hours": [line(7, "Total CPU Hours", fixed(F.col("total"), 0))],
    }
    one_row = {
        "daily_patterns": lambda df: df.select("average_jobs_per_day").limit(1),
        "job_states": lambda df: reports.outcome_rates(df).where("outcome = 'COMPLETED'"),
    }
    parts = [
        one_row.get(name, lambda df: df)(sections[name]).select(F.inline(F.array(*rows)))
        for name, rows in wanted.items()
        if name in sections
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
