"""What the operators of this subpackage share: Arrow blocks, worker-held objects, row counts."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

# Text that a Python worker unpacks into objects at a time.
BLOCK_BYTES = 4 << 20

# Fixed value: the white space that separates words, as a character class.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts take about ``limit`` bytes; one long text stands alone."""
    size, start = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for at, length in enumerate(lengths):
        if at > start and size + length > limit:
            yield batch.slice(start, at - start)
            size, start = 0, at
        size += length
    if batch.num_rows > start:
        yield batch.slice(start)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return pc.fill_null(column, "").to_pylist()


def kept(key: str, make: Callable):
    """An object that a Python worker makes once and keeps for its later tasks."""
    home = sys.modules.setdefault("_curbflow_worker", types.ModuleType("_curbflow_worker"))
    held = home.__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def shipped(spark: SparkSession, path: str):
    """A vocabulary file as a broadcast; its size is that of one vocabulary, whatever the data."""
    with open(path, "rb") as source:
        return spark.sparkContext.broadcast(source.read())


def text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage and tells Spark its size."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
