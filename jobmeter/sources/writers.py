"""JSON and CSV outputs, written by the tasks that hold the rows."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.constants import CATEGORICAL_COLUMNS
from jobmeter.sources.readers import finite

AGGREGATIONS = {
    "by_user": ("user",), "by_account": ("account",), "by_state": ("state",), "by_job_type": ("job_type",),
    "by_day": ("start_day",), "by_hour_of_day": ("start_hour",), "by_day_hour": ("start_day", "start_hour"),
}


def document_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """Sections as JSON lines {"section": ..., "row": {...}}; non-finite numbers become null."""
    def lines(name: str, df: DataFrame) -> DataFrame:
        row = F.struct(
            *[finite(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        )
        body = F.struct(F.lit(name).alias("section"), row.alias("row"))
        return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))

    return reduce(DataFrame.unionByName, (lines(n, df) for n, df in sections.items()))


def write_analysis_json(sections: dict[str, DataFrame], path: str) -> None:
    """Write an analysis as one folder of JSON lines."""
    document_lines(sections).write.mode("errorifexists").text(path)


# Units of an insights document.
UNITS = {"energy": "kWh", "duration": "hours", "timestamps": "UTC ISO-8601", "counts": "jobs"}


def _json(value: Column, kind: str) -> Column:
    """A value as JSON text; null and numbers that are not finite are ``null``."""
    value = finite(value) if kind == "double" else value
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(value.isNull(), F.lit("null")).otherwise(quoted)


def _object(columns: dict[str, tuple[Column, str]]) -> Column:
    fields = [F.concat(F.lit(f'"{name}":'), _json(value, kind)) for name, (value, kind) in columns.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def insights_lines(sections: dict[str, DataFrame], generated_at: str) -> DataFrame:
    """(step, part, key, value): an insights document as lines that make one JSON object in that order.

    Every row of a table is a line of its own, with the comma before it unless it is the first of its
    table, so no row holds a table and no task more than it reads.
    """
    spark = next(iter(sections.values())).sparkSession
    steps: list[str | tuple[DataFrame, Column, Column]] = []

    def rows(df: DataFrame, keys: list[str], as_field: bool = False, value: str | None = None) -> tuple[DataFrame, Column, Column]:
        kinds = dict(df.dtypes)
        body = {c: (F.col(f"`{c}`"), kinds[c]) for c in df.columns if not (as_field and c in keys)}
        text = _json(*body[value]) if value else _object(body)
        if as_field:
            text = F.concat(_json(F.col(f"`{keys[0]}`").cast("string"), "string"), F.lit(":"), text)
        order = F.concat_ws("\u0001", *[F.lpad(F.col(f"`{k}`").cast("string"), 4, "0") if kinds[k] == "int" else F.col(f"`{k}`") for k in keys])
        return df, order, text

    def table(name: str, keys: list[str]) -> None:
        steps.extend([f'"{name}":[', rows(sections[name], keys), "]"])

    def per_table(name: str, section: DataFrame, value: str) -> None:
        steps.append(f'"{name}":{{')
        for i, part in enumerate(("features", "predictions", "merged_records")):
            mine = section.where(F.col("table") == part).select("field", value)
            steps.extend([f'{"," if i else ""}"{part}":{{', rows(mine, ["field"], True, value), "}"])
        steps.append("}")

    stats = sections["summary_stats"]
    header = {"generated_at_utc": generated_at, "units": UNITS}
    steps.append(json.dumps(header)[:-1] + ",")
    per_table("schema", sections["schema"], "type")
    steps.append(",")
    per_table("missingness", sections["missingness"], "missing")
    dataset = sections["dataset"]
    span = _object({"start": (F.col("range_start"), "string"), "end": (F.col("range_end"), "string")})
    counts = F.concat_ws(",", *[F.concat(F.lit(f'"{c}":'), _json(F.col(c), "long")) for c in ("job_count", "unique_users")])
    steps.extend([',"dataset":{', (dataset, F.lit(""), F.concat(counts, F.lit(',"time_range":'), span)), ","])
    steps.extend([rows(stats.withColumn("metric", F.lower("metric")), ["metric"], True), "},"])
    table("job_type_breakdown", ["job_type"])
    steps.append(",")
    table("top_users_by_energy", ["user"])
    steps.append(',"aggregations":{')
    for i, (name, keys) in enumerate(AGGREGATIONS.items()):
        steps.append("," if i else "")
        table(name, list(keys))
    steps.extend(['},"distributions":{"numeric":{', rows(stats, ["metric"], True), '},"categorical":{'])
    categorical = sections["categorical"]
    for i, column in enumerate(CATEGORICAL_COLUMNS):
        mine = categorical.where(F.col("column") == column).select("value", "job_count")
        steps.extend([f'{"," if i else ""}"{column}":{{', rows(mine, ["value"], True, "job_count"), "}"])
    steps.append('}},"model_performance":null}')

    fixed = [(i, 0, "", text) for i, text in enumerate(steps) if isinstance(text, str)]
    lines = [spark.createDataFrame(fixed, "step int, part int, key string, value string")]
    for i, step in enumerate(steps):
        if isinstance(step, str):
            continue
        df, order, text = step
        keyed = df.select(order.alias("key"), text.alias("value"))
        first = keyed.agg(F.min("key")).scalar()
        comma = F.when(F.col("key") == first, F.lit("")).otherwise(F.lit(","))
        lines.append(keyed.select(F.lit(i).alias("step"), F.lit(1).alias("part"), "key", F.concat(comma, "value").alias("value")))
    return reduce(DataFrame.unionByName, lines)


def write_insights_json(sections: dict[str, DataFrame], path: str, generated_at: str) -> None:
    """Write all insights as one nested JSON document, a folder with one text file.

    One task brings the lines into order (on disk, where they are many) and writes them to the file.
    """
    lines = insights_lines(sections, generated_at).repartition(1).sortWithinPartitions("step", "part", "key")
    lines.select("value").write.mode("errorifexists").text(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Write job_key, user, y_true, y_pred as CSV with a header."""
    predictions.select("job_key", "user", "y_true", "y_pred").write.mode("errorifexists").csv(
        path, header=True
    )


def write_carbon_intensity(readings: DataFrame, path: str) -> None:
    """Write readings as parquet, one folder per zone for pruning."""
    readings.write.mode("errorifexists").partitionBy("zone").parquet(path)
