"""Session settings, shared working folders and bounded small sides."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows a summary may have before it is no longer shipped to every executor.
SMALL_SIDE_ROWS = 20_000

_local_scratch: tempfile.TemporaryDirectory | None = None


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("curbflow")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder, because there
    driver and executors are one machine.
    """
    global _local_scratch
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.TemporaryDirectory(prefix="curbflow-")
    return _local_scratch.name


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/curbflow/{label}-{uuid.uuid4().hex}"


@contextmanager
def files_kept_open(spark: SparkSession, most: int) -> Iterator[None]:
    """Tasks of partitioned writes in this block keep a file open per value, ``most`` at a time.

    Otherwise Spark first sorts all rows of a task by the partition columns, in memory that
    grows with its input. Rows of further values are still sorted.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so later steps do not replay it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def settle(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Compute a summary once and hand it back as a join side.

    At most ``max_rows + 1`` rows reach the driver. A summary within the bound
    becomes a broadcast side; a larger one is checkpointed and joined by shuffle.
    """
    # Collecting takes from as few partitions as hold the rows; an Arrow table of a
    # limited frame would cost one more shuffle.
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return cut(df)
    names = [f"c{k}" for k in range(len(df.columns))]
    columns = [[row[k] for row in rows] for k in range(len(names))]
    kinds = [f.type for f in to_arrow_schema(df.schema)]
    if any(isinstance(f.dataType, T.TimestampType) for f in df.schema.fields):
        table = df.limit(max_rows).toArrow()  # zoned times would pass through the local zone
    else:
        table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names).rename_columns(df.columns)
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))
