"""Small helpers that the operators share for rows, scratch tables and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded by bytes and not by rows alone.

    Ten thousand rows of long texts would be hundreds of MB in the JVM and again in Python. A row
    longer than the bound is a batch of its own.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def _give_back() -> None:
    """Return memory that Python, Arrow and the C library hold free to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``function`` over the batches of a task, and nothing of it left in the worker afterwards.

    Spark keeps Python workers for later tasks of any stage; free memory of many of them would add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _give_back()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents in a folder of tables."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, carry: Iterable[str] | None = None, **keys: Column) -> DataFrame:
    """The given key columns plus the row's columns (those in ``carry``, else all) in a struct ``row``.

    Inside an operator no column of the caller can then clash with a working column.
    """
    fields = [col(c) for c in (df.columns if carry is None else carry)]
    row = F.struct(*fields) if fields else F.struct(F.lit(0).alias("_"))
    return df.select(*[c.alias(name) for name, c in keys.items()], row.alias("row"))


def unpacked(df: DataFrame, columns: Iterable[str], results: Mapping[str, Column]) -> DataFrame:
    """The rows of ``packed`` again, with result columns that replace columns of the same name."""
    taken = {name.lower() for name in results}
    kept = [F.col("row")[c].alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(name) for name, c in results.items()])


def ordered(df: DataFrame, columns: Iterable[str], *results: str) -> DataFrame:
    """``df`` with the caller's columns in their order, then the results that are none of them."""
    columns = list(columns)
    have = {c.lower() for c in columns}
    return df.select(*[col(c) for c in [*columns, *[c for c in results if c.lower() not in have]]])


def batch(columns: Mapping[str, object], types: Mapping[str, pa.DataType]) -> pa.RecordBatch:
    """One Arrow batch from arrays by name."""
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, types[k]) for k, x in columns.items()],
        schema=pa.schema([(k, types[k]) for k in columns]),
    )
