"""Registered queries: every operator of the library over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks.fixtures import TABLES, spark_view
from jobmeter.constants import CATEGORICAL_COLUMNS
from jobmeter.functions import power, text, times
from jobmeter import sql
from jobmeter.operators import (
    carbon, daily, energy, lookups, ranking, reconcile, reports, sampling, scripts, sessions, sketches, snapshots, usage,
)
from jobmeter.plans import analyze, features as feature_plans, forecast, insights, model
from jobmeter.session import configure, materialize, scratch_path
from jobmeter.sources import readers, writers
from jobmeter.streaming import usage as live

Query = Callable[["Inputs"], DataFrame]

JOBS_PER_STATE_PARTITION = 250_000
JOBS_IN_MEMORY = 8_000_000  # with more, the state of the streams lies on disk


class Inputs:
    """The derived input tables of one run."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._views:
            if name in TABLES:
                self._views[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name == "features":
                self._views[name] = self.features
            else:
                self._views[name] = spark_view(self.spark, name, self.table)
        return self._views[name]

    @cached_property
    def sacct(self) -> DataFrame:
        return self.table("sacct")

    @cached_property
    def parsed(self) -> DataFrame:
        return feature_plans.parse_times(self.sacct)

    @cached_property
    def jobs(self) -> DataFrame:
        return feature_plans.job_features(self.sacct)

    @cached_property
    def emissions(self) -> DataFrame:
        return self.table("emissions")

    @cached_property
    def features(self) -> DataFrame:
        return feature_plans.feature_table(self.sacct, self.emissions)

    @cached_property
    def predictions(self) -> DataFrame:
        return self.table("predictions")

    @cached_property
    def flat(self) -> DataFrame:
        return self.table("jobs_flat").withColumnsRenamed({"START_": "START", "End_": "End"})

    @cached_property
    def elapsed(self) -> DataFrame:
        return self.table("jobs_elapsed")

    @cached_property
    def by_day(self) -> DataFrame:
        return usage.by_day(self.features)

    @cached_property
    def by_hour(self) -> DataFrame:
        return usage.by_hour_of_day(self.features)

    @cached_property
    def per_day(self) -> DataFrame:
        return analyze.jobs_per_day(self.flat).select("start_day", "job_count")

    @cached_property
    def scripts(self) -> DataFrame:
        return self.table("sbatch_requests")

    @cached_property
    def directives(self) -> DataFrame:
        return scripts.parse_sbatch(self.scripts)

    @cached_property
    def requests(self) -> DataFrame:
        given = F.struct(
            F.col("p_partition").alias("partitionName"),
            F.col("p_nodes").cast("long").alias("nodeCount"),
            F.col("p_cores").cast("long").alias("cpuCores"),
            F.col("p_gpus").cast("long").alias("gpuCount"),
            F.col("p_memory").alias("memoryGigabytes"),
            F.col("p_hours").alias("walltimeHours"),
        )
        return self.table("requests").select(
            "script_id", "sbatchText", given.alias("parameters"), "zone"
        )

    @cached_property
    def readings(self) -> DataFrame:
        return self.table("carbon_intensity")

    @cached_property
    def zoned(self) -> DataFrame:
        """Jobs with a grid zone that depends on their account."""
        site = F.substring("Account", 5, 9).cast("int") % 4
        zone = (
            F.when(site == 0, "US-CAL-CISO").when(site == 1, "US-NY-ISONE").when(site == 2, "US-PJM")
            .otherwise("US-TX-ERCOT")
        )
        return self.jobs.withColumn("zone", zone)

    def path(self, name: str) -> str:
        return scratch_path(self.spark, name)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that the order of summation does not show.

    The small shift moves exact decimal ties off the rounding edge; the SQL twins do the same.
    """
    return df.select(
        *[
            F.round(F.col(f"`{c}`") + 1e-10, 6).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


ANALYSIS_KEYS = {
    "job_states": ["State"], "partition_analysis": ["Partition"], "user_analysis": ["hashed_user"],
    "daily_patterns": ["start_day"],
}
INSIGHT_KEYS = {
    "by_user": ["user"], "by_account": ["account"], "by_state": ["state"], "by_job_type": ["job_type"],
    "by_day": ["start_day"], "by_hour_of_day": ["start_hour"], "by_day_hour": ["start_day", "start_hour"],
    "top_users_by_energy": ["user"], "job_type_breakdown": ["job_type"], "summary_stats": ["metric"],
    "categorical": ["column", "value"], "schema": ["table", "field"], "missingness": ["table", "field"],
}


def _cell(text: Column) -> list[Column]:
    """A cell's text as (amount, text): numbers and flags as amounts, else the text."""
    flag = F.when(text == "true", 1.0).when(text == "false", 0.0)
    amount = F.coalesce(flag, text.try_cast("double"))
    return [amount.alias("amount"), F.when(amount.isNull(), text).alias("text")]


def long_rows(df: DataFrame, section: str, keys: list[str]) -> DataFrame:
    """(section, name, metric, amount, text): every cell of a table, its key columns as the name."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns if c not in keys]
    )
    name = F.concat_ws(" ", *[F.col(f"`{k}`").cast("string") for k in keys])
    return df.select(F.lit(section).alias("section"), name.alias("name"), F.inline(cells)).select(
        "section", "name", "metric", *_cell(F.col("value"))
    )


def _shown_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: times.second_text(F.col(c)) for c, t in df.dtypes if t == "timestamp"})


def _directive_lines(x: Inputs) -> DataFrame:
    """Every directive of every script with its value text."""
    found = F.explode(scripts.directives(F.col("sbatchText"))).alias("directive")
    return x.scripts.select("script_id", found).withColumn(
        "text", scripts.directive_value(F.col("directive"))
    )


# --- sources and sinks: written to the shared folder and read back ---------------------------


def _read_sacct_dir(x: Inputs) -> DataFrame:
    path = x.path("sacct")
    # Some core counts have a fraction.
    cores = F.when(F.col("Elapsed") % 10 == 0, F.col("NCPUS") + 0.5).otherwise(F.col("NCPUS"))
    x.sacct.withColumn("NCPUS", cores).write.csv(path, sep="|", header=True)
    return readers.read_sacct_dir(x.spark, path)


def _read_jobs_csv(x: Inputs) -> DataFrame:
    path = x.path("jobs")
    x.table("jobs_flat").write.csv(path, header=True)
    return readers.read_jobs_csv(x.spark, path)


def _read_emissions(x: Inputs) -> DataFrame:
    path = x.path("emissions")
    x.emissions.write.csv(path, header=True)
    return energy.energy_per_job(readers.read_emissions(x.spark, path))


def _broken(number: Column) -> Column:
    """The number, or NaN or an infinity in some rows, decided by its digits."""
    turn = F.floor(F.abs(number) * 1000) % 5
    return F.when(turn == 0, F.lit(float("nan"))).when(turn == 1, F.lit(float("-inf"))).otherwise(number)


def _read_insights_json(x: Inputs) -> DataFrame:
    # One document with struct, map and array sections; some numbers are not finite on purpose.
    day = F.struct(
        "start_day", "job_count", "energy_total_kwh", _broken(F.col("energy_mean_kwh")).alias("energy_mean_kwh")
    )
    days = x.by_day.agg(F.struct(F.sort_array(F.collect_list(day)).alias("by_day")).alias("aggregations"))
    stats = insights.summary_stats(x.features)
    numbers = F.struct("count", *[_broken(F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "p95")])
    numeric = stats.agg(F.map_from_entries(F.collect_list(F.struct("metric", numbers))).alias("numeric"))
    found = usage.categorical_distribution(x.features, list(CATEGORICAL_COLUMNS))
    counts = found.groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("value", "job_count"))).alias("m"))
    categorical = counts.agg(F.map_from_entries(F.collect_list(F.struct("column", "m"))).alias("categorical"))
    energy_part = F.struct(numbers.alias("energy_kwh"))
    dataset = stats.where("metric = 'energy_kWh'").select(energy_part.alias("dataset"))
    document = days.join(dataset).join(
        numeric.join(categorical).select(F.struct("numeric", "categorical").alias("distributions"))
    )
    path = x.path("insights")
    document.write.json(path)
    read = readers.read_insights_json(x.spark, path)
    flat = read.select(F.inline(F.map_entries("distributions.numeric"))).select("key", "value.*")
    nested = read.select(F.inline(F.map_entries("distributions.categorical"))).select(
        "key", F.inline(F.map_entries("value")).alias("value", "job_count")
    )
    parts = {
        "by_day": (readers.insight_rows(read, "aggregations.by_day"), ["start_day"]),
        "dataset": (read.select("dataset.energy_kwh.*"), []),
        "numeric": (flat, ["key"]),
        "categorical": (nested, ["key", "value"]),
    }
    return readers.union_tables(long_rows(df, name, keys) for name, (df, keys) in parts.items())


def _read_forecast_requests(x: Inputs) -> DataFrame:
    path = x.path("requests")
    # Numbers as texts and decimals, wrong values, broken lines and other documents among the requests.
    line = F.to_json(F.struct("script_id", "sbatchText", "parameters", "zone"))
    n = F.col("script_id")

    def cores(text: str) -> Column:
        mark = F.struct(F.lit("@").alias("cpuCores")).alias("parameters")
        return F.replace(F.to_json(F.struct("script_id", mark)), F.lit('"@"'), F.lit(text))

    shown = (
        F.when(n % 29 == 0, F.substring(line, 1, 25))
        .when(n % 29 == 1, F.lit("[1, 2]"))
        .when(n % 29 == 2, cores('"8"'))
        .when(n % 29 == 3, cores("2.0"))
        .when(n % 29 == 4, cores('"x"'))
        .when(n % 29 == 5, cores("2.5"))
        .when(n % 29 == 6, cores("true"))
        .otherwise(line)
    )
    x.requests.select(shown.alias("value")).write.text(path)
    given = F.col("parameters")
    return readers.read_forecast_requests(x.spark, path, "script_id long").select(
        "script_id", "sbatchText",
        given["partitionName"].alias("partition_name"),
        given["nodeCount"].cast("int").alias("node_count"),
        given["cpuCores"].cast("int").alias("cpu_cores"),
        given["gpuCount"].cast("int").alias("gpu_count"),
        given["memoryGigabytes"].alias("memory_gigabytes"),
        given["walltimeHours"].alias("walltime_hours"),
        "zone", "error",
    )


def _read_carbon_intensity(x: Inputs) -> DataFrame:
    path = x.path("carbon")
    writers.write_carbon_intensity(x.readings, path)
    return _shown_times(readers.read_carbon_intensity(x.spark, path))


def _write_analysis_json(x: Inputs) -> DataFrame:
    path = x.path("analysis")
    writers.write_analysis_json(analyze.analyze_jobs(x.flat), path)
    document = x.spark.read.schema("section string, row map<string,string>").json(path)
    keys = F.create_map(
        *[e for name, keys in ANALYSIS_KEYS.items() for e in (F.lit(name), F.array(*[F.lit(k) for k in keys]))]
    )
    own = F.coalesce(keys[F.col("section")], F.array().cast("array<string>"))
    row = F.col("row")
    name = F.array_join(F.transform(own, lambda k: row[k]), " ")
    cells = F.filter(F.map_entries("row"), lambda e: ~F.array_contains(own, e["key"]))
    return document.select("section", name.alias("name"), F.inline(cells)).select(
        "section", "name", F.col("key").alias("metric"), *_cell(F.col("value"))
    )


def _write_insights_json(x: Inputs) -> DataFrame:
    path = x.path("insights")
    features = materialize(x.features, "features")
    predictions = spark_view(x.spark, "predictions", {"features": features}.__getitem__)
    writers.write_insights_json(insights.insights(features, predictions, write=False), path, "2024-01-01T00:00:00Z")
    document = readers.read_insights_json(x.spark, path)
    tables = {name: f"aggregations.{name}" for name in writers.AGGREGATIONS}
    tables |= {name: name for name in ("job_type_breakdown", "top_users_by_energy")}
    return readers.union_tables(
        long_rows(readers.insight_rows(document, place), name, INSIGHT_KEYS[name]) for name, place in tables.items()
    )


def _write_predictions(x: Inputs) -> DataFrame:
    path = x.path("predictions")
    writers.write_predictions(x.predictions.withColumnRenamed("user_code", "user"), path)
    return x.spark.read.csv(
        path, header=True, schema="job_key string, user int, y_true double, y_pred double"
    )


# --- other compositions -----------------------------------------------------------------------


def _runtime_hours(x: Inputs) -> DataFrame:
    parts = [
        analyze.with_runtime(jobs).select(
            F.lit(times.runtime_method(jobs)).alias("method"), "hashed_user", "hours"
        )
        for jobs in (x.flat, x.elapsed)
    ]
    return parts[0].unionByName(parts[1])


def _to_numeric(x: Inputs) -> DataFrame:
    numeric = feature_plans.to_numeric(x.features)
    return numeric.select(
        "JobID", "NCPUS", "is_gpu_job", "hour_of_day", "day_of_week",
        text.to_numeric(F.col("ReqMem")).alias("req_mem_number"),
    )


def _runtime_string(x: Inputs) -> DataFrame:
    seconds = F.greatest("Elapsed", F.lit(0))
    clock = F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")
    runtime = F.concat(F.floor(seconds / 5000).cast("string"), F.lit("-"), clock)
    return x.sacct.select("JobID", runtime.alias("runtime_text")).withColumn(
        "hours", text.runtime_hours_text(F.col("runtime_text"))
    )


def _total_memory(x: Inputs) -> DataFrame:
    cores = F.coalesce(scripts.total_cores(), F.lit(1))
    return x.directives.select(
        "script_id",
        scripts.total_memory_gb(cores).alias("memory_gb"),
        scripts.total_memory_gb(cores, mem_per_cpu_fix=True).alias("memory_gb_fixed"),
    )


def _modelled(x: Inputs, *columns: Column) -> DataFrame:
    watts = power.power_watts(F.col("alloc_cpu"), F.col("alloc_mem_gb"))
    table = x.jobs.withColumn("power_watts", watts)
    table = table.withColumn(
        "energy_kwh", power.energy_kwh(F.col("power_watts"), F.col("requested_walltime_hours"))
    )
    grams = power.emissions_gco2e(F.col("energy_kwh"), F.lit(250.0))
    table = table.withColumn("emissions_gco2e", grams).withColumn(
        "emissions_kgco2e", power.emissions_kgco2e(F.col("emissions_gco2e"))
    )
    return table.select("JobID", *columns)


def _zone_lookup(x: Inputs) -> DataFrame:
    prefixed = x.sacct.select("JobID", text.node_prefix(F.col("NodeList")).alias("node_prefix"))
    custom = {"SH": "US-NY-ISONE", "node": "US-PJM"}
    found = lookups.zone_lookup(lookups.zone_lookup(prefixed), mapping=custom, name="custom_zone")
    return found.drop("node_prefix")


def _merge_predictions(x: Inputs) -> DataFrame:
    return energy.merge_predictions(x.features, x.predictions).select(
        "JobID", "job_key", "y_true", "y_pred"
    )


def _runtime_describe(x: Inputs) -> DataFrame:
    return analyze.runtime_describe(x.flat).unionByName(analyze.runtime_describe(x.elapsed))


def _rank_codes(x: Inputs) -> DataFrame:
    top = ranking.top_k(usage.by_user(x.features).select("user", "job_count"), "job_count", "user", 10)
    return ranking.rank_codes(top, "job_count", "user", "User")


def _missingness(x: Inputs) -> DataFrame:
    # The predictions and the keys of the features are read from a few written columns.
    narrow = materialize(x.features.select("job_key", "JobID", "User", "energy_kWh", "alloc_gpu", "NCPUS"), "keys")
    predictions = spark_view(x.spark, "predictions", {"features": narrow}.__getitem__)
    return insights.missing_report(insights.profile(x.features, predictions, narrow))


def _forecast_batch(x: Inputs) -> DataFrame:
    return forecast.forecast_batch(x.requests, x.readings).select(
        "script_id", "energy_kwh", "emissions_kgco2e", "emissions_gco2e", "power_watts",
        carbon.INTENSITY, "zone", "inputs.*", F.array_join("notes", "; ").alias("notes"),
    )


def _analyze_jobs(x: Inputs) -> DataFrame:
    sections = analyze.analyze_jobs(x.flat)
    return readers.union_tables(long_rows(df, n, ANALYSIS_KEYS.get(n, [])) for n, df in sections.items())


def _insights(x: Inputs) -> DataFrame:
    features = materialize(x.features, "features")
    predictions = spark_view(x.spark, "predictions", {"features": features}.__getitem__)
    sections = insights.insights(features, predictions, write=False)
    return readers.union_tables(long_rows(df, n, INSIGHT_KEYS.get(n, [])) for n, df in sections.items())


def _cross_validate(x: Inputs) -> DataFrame:
    found = model.cross_validate(x.features, max_samples=500)
    known = F.col("y_pred").isNotNull() & ~F.isnan("y_pred")
    return found.select("job_key", "user", "fold", "y_true", known.alias("has_prediction"))


def _mixed_times(x: Inputs) -> DataFrame:
    start = F.col("Start")
    forms = ["MM/dd/yyyy HH:mm", "d MMM yyyy HH:mm", "yyyyMMdd", "yyyy/MM/dd HH:mm:ss", "'no time'"]
    text_ = F.coalesce(
        *[F.when(F.col("NCPUS") % 6 == i, F.date_format(start, f)) for i, f in enumerate(forms)],
        F.date_format(start, "yyyy-MM-dd HH:mm:ss"),
    )
    return x.parsed.select("JobID", text_.alias("given")).select(
        "JobID", times.second_text(times.utc_timestamp(F.col("given"))).alias("read"),
        times.unreadable(F.col("given")).alias("unreadable"),
    )


def _group_folds(x: Inputs) -> DataFrame:
    return sampling.group_folds(x.jobs.select("JobID", "User"))


def _union_tables(x: Inputs) -> DataFrame:
    return readers.union_tables(
        [x.sacct.select("JobID", "User", "Account", "NCPUS"), x.sacct.select("JobID", "User", "State", "NCPUS")]
    )


def _strict_times(x: Inputs) -> DataFrame:
    return x.flat.select(
        "hashed_user",
        times.second_text(times.strict_utc_timestamp(F.col("START"))).alias("start_text"),
        times.second_text(times.strict_utc_timestamp(F.col("End"))).alias("end_text"),
    )


def placed(df: DataFrame) -> DataFrame:
    """The rows with their place in the result's order, so that a comparison sees the order too."""
    at = F.monotonically_increasing_id()
    return df.withColumn("_at", at).withColumn("place", F.row_number().over(W.orderBy("_at"))).drop("_at")


# --- jobs that go beyond one batch over one export ---------------------------------------------


def _read_mixed_headers(x: Inputs) -> DataFrame:
    # Three exports with other columns, another order, and blanks around the names.
    path = x.path("mixed")
    turn = F.crc32("JobID") % 3
    layouts = [["JobID", "User", "NCPUS"], ["NCPUS", "Partition", "JobID"], ["JobID", "State", "User"]]
    for i, columns in enumerate(layouts):
        named = x.sacct.where(turn == i).select(*[F.col(c).alias(f" {c} " if i == 2 else c) for c in columns])
        named.write.mode("append").csv(path, sep="|", header=True)
    return readers.read_sacct_dir(x.spark, path).select("JobID", "User", "NCPUS", "Partition", "State")


def _incremental_usage(x: Inputs) -> DataFrame:
    # Three deliveries in no order of time; later ones repeat a seventh of the earlier jobs.
    incoming, table = x.path("incoming"), x.path("usage")
    jobs, metered = (f"{incoming}/{name}" for name in ("jobs", "readings"))
    turn, reading_turn = F.crc32("JobID") % 3, F.coalesce(F.crc32("job_key") % 3, F.lit(0))
    exported = materialize(x.sacct.select("JobID", "User", "Start"), "exported")
    readings = materialize(x.emissions, "readings")
    count = exported.count()
    partitions = 4 + count // JOBS_PER_STATE_PARTITION
    for i in range(3):
        again = (turn < i) & (F.crc32("JobID") % 7 == 0)
        exported.where((turn == i) | again).write.mode("append").csv(jobs, sep="|", header=True)
        readings.where(reading_turn == i).write.mode("append").csv(metered, sep="|", header=True)
        live.refresh(
            live.stream_csv(x.spark, jobs, ["JobID", "User", "Start"]),
            live.stream_csv(x.spark, metered, ["job_key", "energy_kWh"]),
            table, delay="400 days", partitions=partitions, on_disk=count > JOBS_IN_MEMORY,
        )
    none = {"start_day": F.lit(None).cast("string"), "start_hour": F.lit(None).cast("int"), "energy_mean_kwh": F.lit(None).cast("double")}
    parts = {"day": live.by_day(x.spark, table), "hour": live.by_hour_of_day(x.spark, table), "cell": live.day_hours(x.spark, table)}
    columns = ["start_day", "start_hour", "job_count", "energy_total_kwh", "energy_mean_kwh"]
    return readers.union_tables(
        df.select(F.lit(name).alias("kind"), *[F.col(c) if c in df.columns else none[c].alias(c) for c in columns])
        for name, df in parts.items()
    )


def _weeks(days: DataFrame) -> DataFrame:
    """(name, first_day, last_day): every week with a job, and the whole time."""
    monday = F.to_date(F.date_trunc("week", "start_day"))
    weeks = days.select(monday.alias("first_day")).distinct()
    weeks = weeks.select(F.col("first_day").cast("string").alias("name"), "first_day", F.date_add("first_day", 6).alias("last_day"))
    whole = days.agg(F.lit("all").alias("name"), F.min("start_day").alias("first_day"), F.max("start_day").alias("last_day"))
    return weeks.unionByName(whole)


def _quantile_sketches(x: Inputs) -> DataFrame:
    # The sketches' quantiles, judged by where they stand among the values themselves.
    values = materialize(x.features.where("Start is not null").select("Start", *sketches.METRICS), "values")
    daily_ = materialize(sketches.daily_quantile_sketches(values), "sketches")
    ranges = _weeks(daily_)
    found = sketches.quantiles(daily_, ranges)
    rows = values.select(
        F.to_date("Start").alias("day"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in sketches.METRICS])),
    )
    names = F.array(F.lit("all"), F.to_date(F.date_trunc("week", "day")).cast("string"))
    ranked = rows.select("metric", "value", F.explode(names).alias("name")).join(F.broadcast(found), ["name", "metric"])
    slack = F.lit(3 * sketches.rank_error())
    checks = []
    for i, (share, name) in enumerate(((0.5, "median_within"), (0.95, "p95_within"))):
        q = F.col("quantiles")[i]
        below, upto = (F.count_if(c) / F.count("value") for c in (F.col("value") < q, F.col("value") <= q))
        checks.append(((below - slack <= share) & (share <= upto + slack)).alias(name))
    return ranked.groupBy("name", "metric", "known").agg(*checks)


def _user_sketches(x: Inputs) -> DataFrame:
    people = materialize(x.features.select("User", "Start"), "people")
    daily_ = materialize(sketches.daily_user_sketches(people), "sketches")
    weeks = _weeks(daily_)
    pairs = weeks.where("name <> 'all'").select(F.col("name").alias("a"), F.date_add("first_day", 7).cast("string").alias("b"))
    shared = sketches.shared_users(daily_, weeks, pairs, sketches.daily_members(people))
    week = F.to_date(F.date_trunc("week", "Start")).cast("string")
    exact = people.where("User is not null and Start is not null").select(
        "User", F.explode(F.array(F.lit("all"), week)).alias("name")
    ).groupBy("name").agg(F.count_distinct("User").alias("exact"))
    close = F.abs(F.col("users") / F.col("exact") - 1) <= 0.02
    return (
        sketches.distinct_users(daily_, weeks).join(exact, "name")
        .join(shared.withColumnRenamed("a", "name").drop("b"), "name", "left")
        .select("name", F.col("exact").alias("users"), close.alias("within_two_percent"), F.col("shared").alias("shared_with_next"))
    )


def _exports(x: Inputs) -> tuple[DataFrame, DataFrame]:
    """Two exports of the jobs: some only in one of them, some in another state, some repeated."""
    n = F.regexp_extract("JobID", "^[0-9]+", 0).cast("long")
    jobs = x.sacct.select("JobID", "User", "State", "NCPUS").withColumn("n", n)

    def repeated(df: DataFrame, rule: Column) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(1), F.when(rule, 2).otherwise(1)))
        return df.withColumn("copy", copies).drop("copy", "n")

    state = F.when(F.col("n") % 13 == 0, "REQUEUED").otherwise(F.col("State"))
    return (
        repeated(jobs.where("n % 7 <> 0"), F.col("n") % 11 == 0),
        repeated(jobs.where("n % 5 <> 0").withColumn("State", state), F.col("n") % 3 == 0),
    )


def _snapshot_changes(x: Inputs) -> DataFrame:
    found = snapshots.difference(*_exports(x), key="JobID")
    return found.select(
        "change", F.col("key").alias("JobID"), "copies", F.col("old.State").alias("old_state"), F.col("new.State").alias("new_state"),
    )


def _snapshot_history(x: Inputs) -> DataFrame:
    old, new = _exports(x)
    dated = [(old, "2024-01-01"), (new, "2024-02-01"), (old.where("NCPUS % 2 = 0"), "2024-03-01")]
    exports = readers.union_tables(df.withColumn("snapshot", F.lit(d)) for df, d in dated)
    return snapshots.history(exports, "JobID").select(
        F.col("key").alias("JobID"), F.col("row.State").alias("state"), "valid_from", "valid_to"
    )


def _sql_functions(x: Inputs) -> DataFrame:
    sql.register(x.spark)
    return x.spark.sql(
        """
SELECT JobID, req_mem_gb(ReqMem) AS req_mem_gb, node_prefix(NodeList) AS node_prefix,
       runtime_string_hours(concat(floor(greatest(Elapsed, 0) / 5000), '-',
         date_format(timestamp_seconds(greatest(Elapsed, 0)), 'HH:mm:ss'))) AS hours
FROM {sacct}""",
        sacct=x.sacct,
    )


def _sql_parse_sbatch(x: Inputs) -> DataFrame:
    sql.register(x.spark)
    return x.spark.sql(
        "SELECT script_id, found.* FROM {scripts}, LATERAL parse_sbatch(sbatchText) AS found", scripts=x.scripts
    )


QUERIES: dict[str, Query] = {
    # Sources and sinks
    "read_sacct_dir": _read_sacct_dir,
    "read_jobs_csv": _read_jobs_csv,
    "read_emissions": _read_emissions,
    "read_insights_json": _read_insights_json,
    "read_forecast_requests": _read_forecast_requests,
    "read_carbon_intensity": _read_carbon_intensity,
    "write_analysis_json": _write_analysis_json,
    "write_insights_json": _write_insights_json,
    "write_predictions": _write_predictions,
    "union_tables": _union_tables,
    # Projections and filters
    "parse_times": lambda x: _shown_times(x.parsed.select("JobID", "Submit", "Start", "End")),
    "parse_times_strict": _strict_times,
    "parse_times_mixed": _mixed_times,
    "job_key": lambda x: x.jobs.select("JobID", "job_key"),
    "req_mem_gb": lambda x: x.jobs.select("JobID", "req_mem_gb"),
    "alloc_tres": lambda x: x.jobs.select("JobID", "alloc_cpu", "alloc_mem_gb", "alloc_gpu"),
    "job_type": lambda x: x.jobs.select("JobID", "is_gpu_job", "job_type"),
    "queue_and_walltime": lambda x: x.jobs.select("JobID", "requested_walltime_hours", "queue_wait_time_hours"),
    "time_parts": lambda x: x.jobs.select("JobID", "hour_of_day", "day_of_week"),
    "runtime_hours": _runtime_hours,
    "cpu_hours": lambda x: analyze.with_cpu_hours(x.flat).select("hashed_user", "NCPUS", "hours", "cpu_hours"),
    "label_encode": lambda x: lookups.label_encode(x.jobs.select("JobID", *CATEGORICAL_COLUMNS)),
    "to_numeric": _to_numeric,
    "select_features": lambda x: feature_plans.select_features(x.features),
    "filter_target": lambda x: feature_plans.filter_target(x.emissions),
    "parse_sbatch": lambda x: x.directives.drop("sbatchText"),
    "walltime_hours": lambda x: _directive_lines(x).where(F.col("directive").startswith("--time")).select(
        "script_id", "text", text.walltime_hours(F.col("text")).alias("walltime_hours")
    ),
    "script_mem_gb": lambda x: _directive_lines(x).where(F.col("directive").startswith("--mem")).select(
        "script_id", "text", text.script_memory_gb(F.col("text")).alias("memory_gb")
    ),
    "gres_gpu_count": lambda x: _directive_lines(x).select(
        "script_id", "directive", text.gpu_request_count(F.col("directive")).alias("gpu_count")
    ),
    "runtime_string_hours": _runtime_string,
    "node_prefix": lambda x: x.sacct.select("JobID", text.node_prefix(F.col("NodeList")).alias("node_prefix")),
    "resolve_request": lambda x: forecast.resolve_request(x.requests),
    "total_cores": lambda x: x.directives.select("script_id", scripts.total_cores().alias("total_cores")),
    "total_memory": _total_memory,
    "power_watts": lambda x: _modelled(x, F.col("power_watts")),
    "energy_kwh": lambda x: _modelled(x, F.col("energy_kwh")),
    "emissions_gco2e": lambda x: _modelled(x, F.col("emissions_gco2e"), F.col("emissions_kgco2e")),
    "forecast_notes": lambda x: forecast.resolve_request(x.requests).select(
        "script_id", "gpu_count", F.array_join(power.forecast_notes(F.col("gpu_count")), "; ").alias("notes")
    ),
    "rank_codes": _rank_codes,
    "local_time": lambda x: x.sacct.select("JobID", times.pacific_time(F.col("Start")).alias("local_start")),
    # Joins
    "join_features": lambda x: x.features.select("JobID", "job_key", "energy_kWh"),
    "repeated_job_keys": lambda x: energy.repeated_job_keys(x.jobs),
    "zone_lookup": _zone_lookup,
    "intensity_lookup": lambda x: carbon.intensity_lookup(
        forecast.resolve_request(x.requests).select("script_id", "zone"), x.readings
    ),
    "intensity_asof": lambda x: carbon.intensity_asof(x.zoned, x.readings).select("JobID", "zone", carbon.INTENSITY),
    "merge_predictions": _merge_predictions,
    # Aggregations over flat rows
    "energy_per_job": lambda x: energy.energy_per_job(x.emissions),
    "runtime_describe": _runtime_describe,
    "jobs_per_day": lambda x: analyze.jobs_per_day(x.flat),
    "date_range": lambda x: analyze.date_range(x.flat),
    "cpu_hours_total": lambda x: analyze.cpu_hours_total(x.flat),
    "state_counts": lambda x: placed(analyze.state_counts(x.flat)),
    "ncpus_describe": lambda x: analyze.ncpus_describe(x.flat),
    "partition_counts": lambda x: analyze.partition_counts(x.flat),
    "top_users": lambda x: analyze.top_users(x.flat),
    "gpu_describe": lambda x: analyze.gpu_describe(x.flat),
    "gpu_job_share": lambda x: analyze.gpu_job_share(x.flat),
    "metadata": lambda x: analyze.metadata(x.flat),
    "outcome_rates": lambda x: analyze.outcome_rates(x.flat),
    # Aggregations over features
    "summary_stats": lambda x: insights.summary_stats(x.features),
    "dataset_summary": lambda x: usage.dataset_summary(x.features),
    "job_type_breakdown": lambda x: usage.job_type_breakdown(x.features),
    "top_users_by_energy": lambda x: usage.top_users_by_energy(x.features),
    "by_user": lambda x: usage.by_user(x.features),
    "by_account": lambda x: usage.by_account(x.features),
    "by_state": lambda x: usage.by_state(x.features),
    "by_job_type": lambda x: usage.by_job_type(x.features),
    "by_day": lambda x: x.by_day,
    "by_hour_of_day": lambda x: x.by_hour,
    "by_day_hour": lambda x: daily.day_hour_matrix(usage.by_day_hour(x.features)),
    "categorical_distribution": lambda x: usage.categorical_distribution(x.features, list(CATEGORICAL_COLUMNS)),
    "missingness": _missingness,
    "schema_table": lambda x: placed(reports.schema_table(x.features)),
    "low_energy_hour_share": lambda x: daily.low_energy_hour_share(x.by_hour),
    "hour_efficiency": lambda x: placed(daily.hour_efficiency(x.by_hour)),
    "runtime_histogram": lambda x: analyze.runtime_histogram(x.flat),
    "cpu_histogram": lambda x: analyze.cpu_histogram(x.flat),
    "duration_classes": lambda x: analyze.duration_classes(x.flat),
    "runtime_p95": lambda x: analyze.runtime_p95(x.flat),
    "user_activity": lambda x: analyze.user_activity(x.flat),
    "user_share": lambda x: analyze.user_share(x.flat),
    "cpu_efficiency": lambda x: analyze.cpu_efficiency(x.flat),
    "peak_days": lambda x: analyze.peak_days(x.flat),
    "fold_metrics": lambda x: model.fold_metrics(x.predictions),
    # Trends
    "sort_by_day": lambda x: placed(daily.sort_by_day(x.by_day)),
    "rolling7": lambda x: daily.rolling7(x.by_day),
    "daily_efficiency": lambda x: daily.energy_per_job_columns(x.by_day),
    "peak_flags": lambda x: daily.peak_flags(x.by_day),
    "median_mad": lambda x: daily.median_mad(x.by_day),
    "efficiency_anomaly": lambda x: daily.efficiency_anomaly(daily.rolling7(x.by_day)).select(
        "start_day", "efficiencyAnomaly"
    ),
    "enrich_by_day": lambda x: daily.enrich_by_day(x.by_day),
    "weekly_average": lambda x: daily.weekly_average(x.per_day),
    "every_7th_day": lambda x: daily.every_7th_day(x.per_day),
    "top_k": lambda x: ranking.top_k(analyze.state_counts(x.flat), "job_count", "State", 8).drop("distinct_values"),
    # Models and whole jobs
    "sample_cap": lambda x: sampling.sample_cap(x.features, max_samples=5000).select("JobID", "job_key", "energy_kWh"),
    "group_folds": _group_folds,
    "snake_folds": lambda x: sampling.group_folds(x.jobs.select("JobID", "User"), mode="snake"),
    "cross_validate": _cross_validate,
    "feature_table": lambda x: _shown_times(x.features),
    "forecast_batch": _forecast_batch,
    "job_emissions": lambda x: forecast.job_emissions(x.zoned, x.readings),
    "analyze_jobs": _analyze_jobs,
    "insights": _insights,
    "text_summary": lambda x: analyze.text_summary(analyze.analyze_jobs(x.flat)),
    # Beyond one batch over one export
    "incremental_usage": _incremental_usage,
    "intensity_over_run": lambda x: carbon.intensity_over_run(x.zoned, x.readings).select("JobID", "zone", carbon.INTENSITY),
    "intensity_with_gaps": lambda x: carbon.intensity_over_run(x.zoned, x.readings, max_hold_hours=1.5).select(
        "JobID", "zone", carbon.INTENSITY
    ),
    "run_emissions": lambda x: forecast.job_emissions(x.zoned, x.readings, whole_run=True),
    "quantile_sketches": _quantile_sketches,
    "user_sketches": _user_sketches,
    "read_mixed_headers": _read_mixed_headers,
    "unmatched_keys": lambda x: reconcile.unmatched_report(x.jobs, x.emissions),
    "snapshot_changes": _snapshot_changes,
    "snapshot_history": _snapshot_history,
    "submit_sessions": lambda x: sessions.submit_sessions(x.parsed).withColumns(
        {c: times.second_text(F.col(c)) for c in ("session_start", "session_end")}
    ),
    "sql_functions": _sql_functions,
    "sql_parse_sbatch": _sql_parse_sbatch,
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registered query over the tables of a folder."""
    return rounded(QUERIES[name](Inputs(spark, sf_dir)))
