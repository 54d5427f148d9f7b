"""Accounting exports, energy readings, carbon readings, request batches, insight documents."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmeter.constants import MISSING_TEXTS, TARGET_COLUMN
from jobmeter.functions.text import to_numeric
from jobmeter.operators.lookups import small_side
from jobmeter.session import materialize
from jobmeter.sources.schemas import FORECAST_REQUEST, INSIGHTS

# Columns that are numbers in an accounting export, fractions included; all others are text.
NUMBER_COLUMNS = ("NCPUS", "NGPUs", "Elapsed")


def union_tables(tables: Iterable[DataFrame]) -> DataFrame:
    """Rows of all tables over the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _read_text_csv(
    spark: SparkSession, paths: list[str] | str, columns: list[str], sep: str, check: bool = False
) -> DataFrame:
    """CSV with every column as text, header names stripped, missing texts as null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.option("pathGlobFilter", "*.csv") if check else spark.read
    raw = reader.csv(
        paths, sep=sep, header=True, schema=schema, enforceSchema=not check, quote='"', escape='"'
    )
    cells = [(F.col(f"`{c}`"), c.strip()) for c in columns]
    return raw.select(*[F.when(~cell.isin(*MISSING_TEXTS), cell).alias(c) for cell, c in cells])


def _typed(df: DataFrame) -> DataFrame:
    numbers = {c: to_numeric(F.col(c)) for c in NUMBER_COLUMNS if c in df.columns}
    return df.withColumns(numbers) if numbers else df


def _columns(line: str, sep: str) -> list[str]:
    """Column names of a header line."""
    return next(csv.reader([line], delimiter=sep), [])


def _header(spark: SparkSession, path: str | list[str], sep: str) -> list[str]:
    """Column names of a file; reads its first line only."""
    return spark.read.csv(path, sep=sep, header=True, quote='"', escape='"').columns


def _first_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, header) of the CSV files of a folder, by one distributed job over their first lines."""
    block = F.col("_metadata.file_block_start")
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder).where(block == 0)
    numbered = lines.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "value")
    return numbered.groupBy("path").agg(F.min_by("value", "at").alias("header"))


#: No line holds this: the CSV source then cuts off header lines and leaves all others whole.
_WHOLE_LINE = "\u0001\u0002\u0001"


def read_sacct_dir(spark: SparkSession, folder: str, same_header: bool = False) -> DataFrame:
    """All ``|``-separated CSV files of a folder as one table over the union of their columns.

    One job finds the header of every file and writes them; the driver gets the distinct headers and
    no path. All files are then one scan of whole lines, each parsed by the header of its file, which
    is joined by path. ``same_header=True`` skips that: Spark then checks the headers while it reads
    the folder and fails on a different one.
    """
    if same_header:
        one = spark.read.option("pathGlobFilter", "*.csv").text(folder).limit(1).collect()
        if not one:
            raise FileNotFoundError(f"no CSV files in {folder}")
        columns = _columns(one[0]["value"], "|")
        return _typed(_read_text_csv(spark, folder, columns, "|", check=True))
    files = materialize(_first_lines(spark, folder), "headers")
    found = files.groupBy("header").agg(F.min("path").alias("path")).orderBy("path").collect()
    if not found:
        raise FileNotFoundError(f"no CSV files in {folder}")
    headers = [row["header"] for row in found]
    lines = spark.read.option("pathGlobFilter", "*.csv").csv(
        folder, schema="line string", sep=_WHOLE_LINE, header=True, enforceSchema=True, quote="", escape=""
    )
    lines = lines.select("line", F.col("_metadata.file_path").alias("path"))
    if len(headers) > 1:
        number = reduce(lambda c, i: c.when(F.col("header") == headers[i], i), range(len(headers)), F.when(F.lit(False), -1))
        lines = lines.join(small_side(files.select("path", number.alias("kind"))), "path")
    parsed = []
    for i, header in enumerate(headers):
        columns = _columns(header, "|")
        schema = ", ".join(f"`c{j}` string" for j in range(len(columns)))
        cells = F.from_csv("line", schema, {"sep": "|", "quote": '"', "escape": '"'})
        parsed.append((f"_{i}", columns, F.when(F.col("kind") == i, cells) if len(headers) > 1 else cells))
    table = lines.select(*[cells.alias(name) for name, _, cells in parsed])
    cells_of: dict[str, list[Column]] = {}
    for name, columns, _ in parsed:
        for j, c in enumerate(columns):
            cells_of.setdefault(c.strip(), []).append(F.col(f"{name}.c{j}"))
    value = {c: F.coalesce(*cells) if len(cells) > 1 else cells[0] for c, cells in cells_of.items()}
    return _typed(table.select(*[F.when(~v.isin(*MISSING_TEXTS), v).alias(c) for c, v in value.items()]))


def read_jobs_csv(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated accounting export; a missing path is an error."""
    try:
        columns = _header(spark, path, ",")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"file not found: {path}") from error
        raise
    return _typed(_read_text_csv(spark, path, columns, ","))


def read_emissions(spark: SparkSession, path: str) -> DataFrame:
    """Metered energy rows (job_key, energy_kWh); other columns are dropped."""
    table = read_jobs_csv(spark, path)
    for c in ("job_key", TARGET_COLUMN):
        if c not in table.columns:
            raise ValueError(f"the emissions table must include {c}")
    return table.select("job_key", to_numeric(F.col(TARGET_COLUMN)).alias(TARGET_COLUMN))


def read_carbon_intensity(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Readings (zone, reading_ts, carbon_intensity) from parquet or CSV."""
    if format == "csv":
        schema = "zone string, reading_ts timestamp, carbon_intensity double"
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.format(format).load(path).select(
        "zone",
        F.col("reading_ts").cast("timestamp").alias("reading_ts"),
        F.col("carbon_intensity").cast("double").alias("carbon_intensity"),
    )


def _checked(document: Column, path: str, kind: T.DataType) -> tuple[Column, Column]:
    """A field of a request as its declared type, and what is wrong with it (null if nothing is).

    Whole numbers may be given as such, as decimals without a fraction, as texts of these, or as
    flags; numbers as any of these or as decimals; texts only as texts. Absent and null are missing.
    """
    given = F.try_variant_get(document, f"$.{path}", "variant")
    form = F.schema_of_variant(given)
    text = F.try_variant_get(document, f"$.{path}", "string")
    missing = given.isNull() | (form == "VOID")
    flag = F.when(text == "true", 1).when(text == "false", 0)
    number = F.when(form == "BOOLEAN", flag.cast("double")).otherwise(text.try_cast("double"))
    scalar = form.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|STRING|BOOLEAN)")
    match kind:
        case T.StringType():
            value, fits, wanted = text, form == "STRING", "a text"
        case T.LongType():
            digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)(\.0*)?\s*$", 1).try_cast("long")
            whole = F.when(form == "BOOLEAN", flag.cast("long")).otherwise(
                F.coalesce(digits, F.when(form.rlike("^(DOUBLE|FLOAT)") & (number % 1 == 0), number.try_cast("long")))
            )
            value, fits, wanted = whole, scalar & whole.isNotNull(), "a whole number"
        case _:
            value, fits, wanted = number, scalar & finite(number).isNotNull(), "a number"
    problem = F.when(~missing & ~F.coalesce(fits, F.lit(False)), F.lit(f"{path} is not {wanted}"))
    return F.when(~missing & problem.isNull(), value), problem


def read_forecast_requests(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """Forecast requests, one JSON object per line, with ``error``: every field is optional.

    A bad request is a row with its problems in ``error`` and no parameters; no row is dropped and
    no batch fails. ``error`` is null for good requests. Lines of white space alone are no rows.
    ``keys`` declares extra columns that identify a request, e.g. ``"script_id long"``; an unreadable
    key is null.
    """
    extra = spark.createDataFrame([], keys).schema.fields if keys else []
    document = F.col("_document")
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("_document"))
    form = F.schema_of_variant(document)
    parts, problems = {}, []
    for field in FORECAST_REQUEST.fields:
        if isinstance(field.dataType, T.StructType):
            inner = F.schema_of_variant(F.try_variant_get(document, f"$.{field.name}", "variant"))
            shape = inner.isNull() | inner.rlike("^(VOID|OBJECT)")
            problems.append(F.when(~shape, F.lit(f"{field.name} is not an object")))
            values = []
            for sub in field.dataType.fields:
                value, problem = _checked(document, f"{field.name}.{sub.name}", sub.dataType)
                values.append(value.alias(sub.name))
                problems.append(F.when(shape, problem))
            parts[field.name] = F.struct(*values)
        else:
            parts[field.name], problem = _checked(document, field.name, field.dataType)
            problems.append(problem)
    listed = F.nullif(F.concat_ws("; ", *problems), F.lit(""))
    error = (
        F.when(document.isNull(), "not JSON").when(~form.startswith("OBJECT"), "not an object").otherwise(listed)
    )
    given = lines.withColumn("error", error)
    good = F.col("error").isNull()
    return given.select(
        *[F.try_variant_get(document, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in extra],
        *[F.when(good, value).alias(name) for name, value in parts.items()],
        "error",
    )


def finite(column: Column) -> Column:
    """Number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def finite_deep(column: Column, kind: T.DataType) -> Column:
    """The column with every non-finite number inside structs, arrays and maps as null."""
    match kind:
        case T.DoubleType() | T.FloatType():
            return finite(column)
        case T.StructType():
            fields = [finite_deep(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(column.isNotNull(), F.struct(*fields))
        case T.ArrayType():
            return F.transform(column, lambda x: finite_deep(x, kind.elementType))
        case T.MapType():
            return F.transform_values(column, lambda _, x: finite_deep(x, kind.valueType))
    return column


def read_insights_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Insight documents under the declared schema; NaN and infinities become null everywhere."""
    raw = spark.read.schema(INSIGHTS).json(path, multiLine=multi_line, allowNonNumericNumbers=True)
    return raw.select(*[finite_deep(F.col(f.name), f.dataType).alias(f.name) for f in raw.schema.fields])


def insight_rows(document: DataFrame, section: str) -> DataFrame:
    """One table of a document, e.g. ``aggregations.by_user``."""
    return document.select(F.inline(section))
