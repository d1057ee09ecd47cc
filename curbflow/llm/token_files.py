"""Token ids as Parquet list columns, sorted by document, with page indexes.

Documents are range-partitioned by id, sorted, encoded and written by Spark's Parquet
writer: one list of ids per document, dictionary or delta encoded, in row groups and
pages of a chosen size. Every column chunk carries page indexes, so that a reader of few
documents fetches few pages, and a reader of the metadata columns fetches no ids.

A folder holds ``tokens`` (``doc_id``, ``part``, ``part_start``, ``n_tokens``, ``ids``) and
``parts``, one row per part with the ids in all parts before it. ``parts`` is written last:
a folder without it was never finished.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_path
from .common import kept, shipped, slices, texts_of
from .packing import ByteLevel

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1_000
ENCODINGS = ("dictionary", "delta")


def _writer_options(encoding: str, row_group_bytes: int, page_bytes: int, page_rows: int) -> dict[str, str]:
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}, not {encoding!r}")
    return {
        # Version 2 writes integers without a dictionary as binary-packed deltas.
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Documents in ascending order with their ids, and where they start within their part.

    Rows under one id follow a hash of their text; rows equal in both may fall into any
    order, which shows in no column. The source partition ends the sort key, so that not
    even a third of all rows with one id and text stay together in a task.
    """
    spec = shipped(docs.sparkSession, tokenizer)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", "_text_hash", "_source"]
    ranged = (
        rows.withColumns({"_text_hash": F.xxhash64("text"), "_source": F.spark_partition_id()})
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(f"byte:{tokenizer}:{zlib.crc32(spec.value)}", lambda: ByteLevel(spec.value))
        done = 0
        for batch in batches:
            for block in slices(batch, 1):
                found = []
                for text in texts_of(block.column(1)):
                    ids = codec.ids(text)
                    ids.append(end_id)
                    found.append(np.frombuffer(ids, np.uint32))
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column(0), block.column(2), pa.array(done + ends - sizes), pa.array(sizes),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(0, ends).astype(np.int32)),
                            pa.array(np.concatenate(found).astype(np.int32)),
                        ),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                done += int(ends[-1])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranged.mapInArrow(run, f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>")


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Write the ids of every whole text, each followed by ``end_id``, below a new ``path``.

    A null text counts as empty (the end id alone). Null ids come first, repeated rows are
    written as often as they occur, an empty table gives files without rows, and other
    columns are not read. Tokenised in one pass over a range shuffle of the texts; a lost
    task writes its file anew and Spark commits one attempt only.
    """
    options = _writer_options(encoding, row_group_bytes, page_bytes, page_rows)
    encoded(docs, tokenizer, end_id, id_col, text_col).write.options(**options).parquet(f"{path}/tokens")
    # One row per part, summed from the metadata column of the files; the window
    # sees as many rows as there are parts.
    spark = docs.sparkSession
    totals = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")
    )
    before = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("tokens")
    totals.withColumn("before", before).coalesce(1).write.parquet(f"{path}/parts")
    return path


def _in_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tokens")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` and ``n_tokens`` of every document; the pages of ids are not read."""
    return _with_start(_in_files(spark, path).select("doc_id", "part", "part_start", "n_tokens"), spark, path)


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``start`` in place of part and place within it; the parts join by Spark's choice."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    others = [c for c in rows.columns if c not in ("doc_id", "part", "part_start")]
    return rows.join(parts, "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), *others
    )


def read_documents(spark: SparkSession, path: str, condition: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` of the documents meeting a condition on ``doc_id``.

    Files are sorted by it, so row-group statistics and page indexes skip the rest.
    """
    return _with_start(_in_files(spark, path).where(condition), spark, path)


def read_span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Every document with an id at a place from ``first`` to ``last`` (not included) of the whole stream.

    Parts that lie elsewhere are found among their totals; within a part, the sorted
    column ``part_start`` skips pages.
    """
    rows = _in_files(spark, path)
    near = spark.read.parquet(f"{path}/parts").where(
        (F.col("before") < last) & (F.col("before") + F.col("tokens") > first)
    ).select("part", "before").withColumnRenamed("part", "_part")
    start = F.col("before") + F.col("part_start")
    return (
        rows.join(near, F.col("part") == F.col("_part"))
        .where((start < last) & (start + F.col("n_tokens") > first))
        .select("doc_id", start.alias("start"), "n_tokens", "ids")
    )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the ids in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy().astype("<u4")).tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    rows = _in_files(spark, path).select("doc_id", "part", "part_start", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    read = rows.mapInArrow(run, f"doc_id {kind}, part int, part_start long, n_tokens long, ids_crc32 long")
    return _with_start(read, spark, path)


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files below the shared one."""
    return fresh_path(spark, "tokens")
