"""Every section of the insights document from the feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmeter.constants import CATEGORICAL_COLUMNS, TARGET_COLUMN
from jobmeter.functions.times import day_text
from jobmeter.operators import reports, usage
from jobmeter.operators.describe import summary_stats as _summary_stats
from jobmeter.operators.energy import merge_predictions
from jobmeter.session import materialize

SUMMARY_COLUMNS = (TARGET_COLUMN, "requested_walltime_hours", "queue_wait_time_hours")

# Sections served by one pass: name -> grouping columns of the shared rollup.
ROLLUPS = {
    "by_user": ("user",),
    "by_account": ("account",),
    "by_state": ("state",),
    "by_job_type": ("job_type",),
    "by_day": (usage.START_DAY,),
    "by_hour_of_day": (usage.START_HOUR,),
    "by_day_hour": (usage.START_DAY, usage.START_HOUR),
}
_KEYS = ("user", "account", "state", "job_type", usage.START_DAY, usage.START_HOUR)


def summary_stats(features: DataFrame, exact: bool = True) -> DataFrame:
    """count, min, max, mean, median and p95 of energy, walltime and queue wait."""
    return _summary_stats(features, {c: F.col(c) for c in SUMMARY_COLUMNS}, exact)


def usage_rollup(features: DataFrame) -> DataFrame:
    """All usage tables in one pass (grouping sets); the result has one row per group.

    ``_mask`` marks the columns a row does *not* group by, first key in the highest bit. Groups
    with a missing key are kept here and left out by the sections.
    """
    keyed = features.select(
        F.col("User").alias("user"),
        F.col("Account").alias("account"),
        F.col("State").alias("state"),
        "job_type",
        F.to_date("Start").alias(usage.START_DAY),
        F.hour("Start").alias(usage.START_HOUR),
        TARGET_COLUMN, "queue_wait_time_hours", "requested_walltime_hours",
    )
    sets = [[F.col(c) for c in columns] for columns in ROLLUPS.values()]
    table = keyed.groupingSets(sets, *[F.col(c) for c in _KEYS]).agg(
        F.grouping_id(*_KEYS).alias("_mask"), *usage.energy_columns(), *usage.wait_columns()
    )
    return table.withColumn(usage.START_DAY, day_text(F.col(usage.START_DAY)))


def rollup_section(rollup: DataFrame, name: str) -> DataFrame:
    """One section of the shared rollup."""
    keys = ROLLUPS[name]
    mask = sum(1 << (len(_KEYS) - 1 - i) for i, c in enumerate(_KEYS) if c not in keys)
    table = rollup.where(F.col("_mask") == mask)
    for c in keys:
        table = table.where(F.col(c).isNotNull())
    metrics = ["job_count", "energy_total_kwh"]
    if name != "by_day_hour":
        metrics.append("energy_mean_kwh")
    if len(keys) == 1 and keys[0] not in (usage.START_DAY, usage.START_HOUR):
        metrics += ["queue_wait_time_hours_mean", "requested_walltime_hours_mean"]
    return table.select(*keys, *metrics)


def _other_profiles(
    own: DataFrame, features: DataFrame, predictions: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """The profile of the features with those of the predictions and of the merged records.

    A left join keeps each feature row once, so the feature columns of the merged records count as
    in the features. Only ``job_key`` takes part in the join that counts the prediction columns;
    ``keys`` is a table of the features' keys, where one is at hand.
    """
    clashes = {c: f"{c}_pred" for c in predictions.columns if c != "job_key" and c in features.columns}
    keyed = merge_predictions(
        (features if keys is None else keys).select("job_key"), predictions.withColumnsRenamed(clashes)
    )
    merged = own.withColumn("table", F.lit("merged_records")).unionByName(
        reports.column_profile(keyed.drop("job_key"), "merged_records")
    )
    return own.unionByName(reports.column_profile(predictions, "predictions")).unionByName(merged)


def profile(
    features: DataFrame, predictions: DataFrame | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """(table, field, type, known, missing) of the features, the predictions and the merged records.

    The features are counted in one pass, whose single row is written; no feature column is. ``keys``
    is a table of the features' keys, where one is at hand.
    """
    counted = materialize(features.agg(*reports.profile_counts(features)), "profile")
    own = reports.profile_rows(counted, features, "features")
    return own if predictions is None else _other_profiles(own, features, predictions, keys)


def missing_report(profiled: DataFrame) -> DataFrame:
    """(table, field, missing) of a profile, most missing first."""
    found = profiled.where("missing > 0").select("table", "field", "missing")
    return found.orderBy("table", F.desc("missing"), "field")


def insights(
    features: DataFrame, predictions: DataFrame | None = None, exact: bool = True, write: bool = True
) -> dict[str, DataFrame]:
    """All sections as tables.

    The feature table is written once to the shared folder (``write=False`` if it already is a
    table), so the join below it runs once. Three scans of it follow: the seven usage tables come
    from one pass, whose small result is written and filtered per section (the counts of categorical
    values are among it); the profile of all columns and the summary of the data from a second; the
    numbers of the summary statistics from a third.
    """
    if write:
        features = materialize(features, "features")
    rollup = materialize(usage_rollup(features), "rollup")
    sections = {name: rollup_section(rollup, name) for name in ROLLUPS}
    totals = sections["by_user"].select("user", "energy_total_kwh")
    sections["top_users_by_energy"] = totals.orderBy(F.desc("energy_total_kwh"), "user").limit(10)
    sections["job_type_breakdown"] = sections["by_job_type"].select(
        "job_type", "job_count", "energy_total_kwh", "energy_mean_kwh"
    )
    counted = materialize(features.agg(*reports.profile_counts(features), *usage.dataset_counts()), "counts")
    users = sections["by_user"].agg(F.count("*").alias("unique_users")).scalar()
    sections["dataset"] = usage.dataset_row(counted.withColumn("unique_users", users))
    sections["summary_stats"] = summary_stats(features, exact)
    values = [
        sections[f"by_{c.lower()}"].select(
            F.lit(c).alias("column"), F.col(c.lower()).cast("string").alias("value"), "job_count"
        )
        for c in CATEGORICAL_COLUMNS
    ]
    sections["categorical"] = reduce(DataFrame.unionByName, values)
    profiled = reports.profile_rows(counted, features, "features")
    if predictions is not None:
        profiled = materialize(_other_profiles(profiled, features, predictions), "profile")
    sections["schema"] = profiled.select("table", "field", "type", "known")
    sections["missingness"] = missing_report(profiled)
    return sections
