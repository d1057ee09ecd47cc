"""Monthly trip files in, partitioned trip tables out."""

from __future__ import annotations

import json
import re
import uuid
import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CAB_TYPES, FILE_KEYS, empty_trips, normalise

# How published and cleaned monthly files are named.
RAW_PATTERN = {
    "yellow": "yellow_tripdata_{year}-{month:02d}*.parquet",
    "green": "green_tripdata_{year}-{month:02d}*.parquet",
    "fhv": "fhv_tripdata_{year}-{month:02d}*.parquet",
    "hvfhv": "fhvhv_tripdata_{year}-{month:02d}*.parquet",
}
CLEANED_PATTERN = {
    "yellow": "cleaned_yellow_tripdata_{year}-{month:02d}*.parquet",
    "green": "cleaned_green_tripdata_{year}-{month:02d}*.parquet",
    "fhv": "cleaned_fhv_tripdata_{year}-{month:02d}*.parquet",
    "hvfhv": "fhvhv_green_tripdata_{year}-{month:02d}*.parquet",
}


# Pages carry a checksum when written and are held against it when read; pages of files
# that other writers left without one are read as they are.
WRITE_CHECKSUMS = {"parquet.page.write-checksum.enabled": "true"}
VERIFY_CHECKSUMS = {"parquet.page.verify-checksum.enabled": "true"}


def _hadoop_path(spark: SparkSession, path: str):
    """A path and the file system it lives on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _data_files(spark: SparkSession, pattern: str) -> list[str]:
    """Data files that a pattern names, directly or as folders of part files; one listing."""
    place, system = _hadoop_path(spark, pattern)
    found = []
    for status in system.globStatus(place) or []:
        if status.isFile():
            found.append(status.getPath().toString())
            continue
        inside = system.listFiles(status.getPath(), True)
        while inside.hasNext():
            name = inside.next().getPath()
            if not name.getName().startswith(("_", ".")):
                found.append(name.toString())
    return sorted(found)


def _monthly_files(spark: SparkSession, root: str, cab: str, year: int, months, patterns) -> list[tuple[str, int]]:
    """Files of a cab type with their month, which follows the part of the pattern before it."""
    before, after = patterns[cab].split("{month:02d}")
    before = before.format(year=year)
    tail = before.rsplit("/", 1)[-1]
    wanted = set(months)
    found = []
    for path in _data_files(spark, f"{root}/{before}[0-9][0-9]{after}"):
        month = int(path.rsplit(tail, 1)[-1][:2])
        if month in wanted:
            found.append((path, month))
    return found


def _why_unreadable(spark: SparkSession, path: str) -> str | None:
    """The first line of what reading a file's footer raises, None if it can be read."""
    try:
        spark.read.parquet(path).schema
    except (PySparkException, Py4JJavaError) as problem:
        return str(problem).strip().splitlines()[0][:200]
    return None


def _rows_read(spark: SparkSession, paths: list[str], schema=None) -> dict[str, int]:
    """Rows per file that a lenient scan yields: by footers alone, or by reading ``schema``.

    A page whose bytes do not meet their checksum ends its file there. The result has a row per file, like the listing it is compared with.
    """
    reader = spark.read.options(ignoreCorruptFiles="true", **VERIFY_CHECKSUMS).schema(schema or "_absent int")
    scan = reader.parquet(*paths).withColumn("_path", F.col("_metadata.file_path"))
    # A hash of every column makes the scan read every page.
    seen = F.lit(0) if schema is None else F.xxhash64(*[F.col(f"`{c}`") for c in schema.names])
    counted = scan.groupBy("_path").agg(F.count(F.lit(1)).alias("n"), F.max(seen).alias("h")).collect()
    return {_plain(r["_path"]): r["n"] for r in counted}


def _plain(path: str) -> str:
    """A path without scheme and escapes, as both the listing and the scan can give it."""
    return unquote(re.sub("^[a-z0-9]+:/+", "/", path))


def file_manifest(
    spark: SparkSession, root: str, cab_types=CAB_TYPES, year: int = 2024,
    patterns: dict[str, str] = RAW_PATTERN, months=range(1, 13), deep: bool = False,
) -> list[dict]:
    """What is known of every monthly file: keys, ``path``, ``rows`` and ``error`` (None if sound).

    One listing per cab type and one distributed pass over the footers. ``deep`` also
    reads every page and its checksum, so that damage a footer does not show is found,
    damage that would still decode included. A bad file counts as bad whole: its ``rows``
    are 0.
    """
    files = [
        {"cab_type": cab, "file_year": year, "file_month": month, "path": path, "rows": 0, "error": None}
        for cab in cab_types
        for path, month in _monthly_files(spark, root, cab, year, months, patterns)
    ]
    if not files:
        return []
    rows = _rows_read(spark, [f["path"] for f in files])
    for file in files:
        file["rows"] = rows.get(_plain(file["path"]), 0)
    silent = [f for f in files if not f["rows"]]
    with ThreadPoolExecutor(max_workers=8) as pool:
        for file, error in zip(silent, pool.map(lambda f: _why_unreadable(spark, f["path"]), silent)):
            file["error"] = error and f"unreadable: {error}"
    if deep:
        for cab in cab_types:
            sound = [f["path"] for f in files if f["cab_type"] == cab and not f["error"]]
            for schema, paths in _by_schema(spark, sound):
                read, among = _rows_read(spark, paths, schema), set(paths)
                for file in files:
                    if file["path"] in among and read.get(_plain(file["path"]), 0) != file["rows"]:
                        file["rows"], file["error"] = 0, "damaged: not all rows can be read"
    return files


def _schema_of(spark: SparkSession, paths: list[str]):
    """Common schema of sound files from their footers."""
    return spark.read.option("mergeSchema", "true").parquet(*paths).schema


def _by_schema(spark: SparkSession, paths: list[str]) -> list[tuple[T.StructType, list[str]]]:
    """Files grouped so that each group can be read by one scan.

    Published files change integer and float widths from file to file, which one
    scan cannot read. Mostly they agree, so all are tried together first.
    """
    if not paths:
        return []
    try:
        return [(_schema_of(spark, paths), paths)]
    except (PySparkException, Py4JJavaError) as problem:
        if "CANNOT_MERGE_SCHEMAS" not in str(problem):
            raise
        with ThreadPoolExecutor(max_workers=8) as pool:
            schemas = list(pool.map(lambda path: _schema_of(spark, [path]), paths))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for path, schema in zip(paths, schemas):
        groups.setdefault(schema.json(), (schema, []))[1].append(path)
    return list(groups.values())


def _scan(
    spark: SparkSession, paths: list[str], schema, cab_type: str, year: int, month: Column,
    columns, row_ids: bool,
) -> DataFrame:
    """One scan over files of equal schema, in canonical form with file keys."""
    raw = spark.read.schema(schema).options(ignoreCorruptFiles="false", **VERIFY_CHECKSUMS).parquet(*paths)
    keys = {"cab_type": F.lit(cab_type), "file_year": F.lit(year), "file_month": month}
    if row_ids:
        keys["source_file"] = F.col("_metadata.file_path")
        keys["source_row"] = F.col("_metadata.row_index")
    trips = normalise(raw.select("*", *[value.alias(name) for name, value in keys.items()]), cab_type)
    if columns is not None:
        trips = trips.select(*[c for c in columns if c in trips.columns], *keys)
    return trips


def read_trips(
    spark: SparkSession, root: str, cab_types=CAB_TYPES, year: int = 2024, columns=None,
    patterns: dict[str, str] = RAW_PATTERN, months=range(1, 13), row_ids: bool = False,
    on_bad_file: str = "fail",
) -> DataFrame:
    """All monthly files of the cab types below ``root``; absent months are warned about.

    One scan per cab type and file schema. A file whose footer cannot be read is left
    out whole and warned about. Damage found while reading fails the read, unless
    ``on_bad_file`` is "skip": then every page is read once beforehand and damaged files
    are left out whole and warned about as well. ``row_ids`` adds each row's file and
    position in it: a unique key that is the same when a lost task runs again.
    """
    if on_bad_file not in ("fail", "skip"):
        raise ValueError("on_bad_file must be 'fail' or 'skip'")
    files = file_manifest(spark, root, cab_types, year, patterns, months, deep=on_bad_file == "skip")
    parts = []
    for cab in cab_types:
        mine = [f for f in files if f["cab_type"] == cab]
        for file in mine:
            if file["error"]:
                warnings.warn(f"left out {file['path']}: {file['error']}", stacklevel=2)
        for month in sorted(set(months) - {f["file_month"] for f in mine if not f["error"]}):
            warnings.warn(f"no readable file for {cab} {year}-{month:02d}", stacklevel=2)
        before = patterns[cab].split("{month")[0].format(year=year).rsplit("/", 1)[-1]
        after = F.substring_index(F.col("_metadata.file_path"), before, -1)
        file_month = F.substring(after, 1, 2).cast("int")
        for schema, group in _by_schema(spark, [f["path"] for f in mine if not f["error"]]):
            parts.append(_scan(spark, group, schema, cab, year, file_month, columns, row_ids))
    if not parts:
        keys = {"cab_type": "string", "file_year": "int", "file_month": "int"}
        return empty_trips(spark, columns).withColumns(
            {name: F.lit(None).cast(kind) for name, kind in keys.items()}
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def file_row_counts(trips: DataFrame) -> DataFrame:
    """Rows per file with the cab type's total, the grand total and the type's share.

    ``trips`` has a row per trip, or a row per file with its ``rows`` (see
    ``manifest_frame``), where a file that cannot be read counts 0. Counting trips
    reads no column, so Parquet answers it from row-group footers.
    """
    counted = F.sum("rows") if "rows" in trips.columns else F.count(F.lit(1))
    files = trips.groupBy(*FILE_KEYS).agg(counted.alias("file_rows"))
    types = files.groupBy("cab_type").agg(F.sum("file_rows").alias("type_rows"))
    overall = files.agg(F.sum("file_rows")).scalar()
    share = F.coalesce(F.col("type_rows") / F.nullif(F.col("overall_rows"), F.lit(0)), F.lit(0.0))
    return files.join(types, "cab_type").withColumn("overall_rows", overall).withColumn("type_share", share)


def manifest_frame(spark: SparkSession, files: list[dict]) -> DataFrame:
    """The manifest as a table, one row per file."""
    schema = "cab_type string, file_year int, file_month int, path string, rows bigint, error string"
    return spark.createDataFrame([tuple(f.values()) for f in files], schema)


def write_monthly(trips: DataFrame, root: str, rebalance: bool = False) -> None:
    """Write one partition per cab type, year and month, replacing only those present.

    Trips read from monthly files are in month order already, so each task writes
    what it read and nothing is shuffled. For trips in another order ``rebalance``
    gathers partitions first, letting adaptive execution split a month that holds
    much of the data and merge small ones.

    The write is staged: partitions go to a folder of their own, their rows are counted
    from the files and held against the rows that were to be written, and one rename
    publishes a manifest of the partitions that now make up the table. Readers see the
    table before or after, whatever is lost on the way. Replaced partitions are
    removed once the next write has been published.
    """
    spark = trips.sparkSession
    former, number = _manifest(spark, root)
    version = f"{root}/data/version={number + 1}-{uuid.uuid4().hex[:12]}"
    out = trips.withColumnsRenamed({"file_year": "year", "file_month": "month"})
    seen = Observation()
    staged = out.observe(seen, F.count(F.lit(1)).alias("rows"))
    if rebalance:
        staged = staged.hint("rebalance", *PARTITIONS)
    staged.write.options(**WRITE_CHECKSUMS).partitionBy(*PARTITIONS).parquet(version)
    expected = seen.get["rows"]
    written = _partitions_of(spark, version) if expected else []
    if sum(p["rows"] for p in written) != expected:
        raise RuntimeError(f"{sum(p['rows'] for p in written)} of {expected} rows arrived in {version}")
    replaced = {tuple(p["key"]) for p in written}
    kept = [p for p in former["partitions"] if tuple(p["key"]) not in replaced]
    schema = former["schema"] if not expected and former["schema"] else out.schema.json()
    _publish(spark, root, number + 1, {"partitions": [*kept, *written], "schema": schema})
    _remove_unlisted(spark, root, number)


PARTITIONS = ["cab_type", "year", "month"]


def _partitions_of(spark: SparkSession, version: str) -> list[dict]:
    """Key, folder and rows of every partition of a written version, rows taken from the footers."""
    counted = (
        spark.read.parquet(version).groupBy(*PARTITIONS)
        .agg(F.count(F.lit(1)).alias("rows"), F.min("_metadata.file_path").alias("path")).collect()
    )
    return [
        {"key": [r[k] for k in PARTITIONS], "rows": r["rows"], "path": unquote(r["path"].rsplit("/", 1)[0])}
        for r in counted
    ]


def _manifest(spark: SparkSession, root: str) -> tuple[dict, int]:
    """The newest published manifest and its number; an empty one and 0 before the first."""
    place, system = _hadoop_path(spark, f"{root}/manifest")
    numbers = [
        int(status.getPath().getName()[:-5])
        for status in (system.listStatus(place) if system.exists(place) else [])
        if status.getPath().getName().endswith(".json") and not status.getPath().getName().startswith((".", "_"))
    ]
    if not numbers:
        return {"partitions": [], "schema": None}, 0
    source = system.open(_hadoop_path(spark, f"{root}/manifest/{max(numbers)}.json")[0])
    content = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    source.close()
    return json.loads(content), max(numbers)


def _publish(spark: SparkSession, root: str, number: int, manifest: dict) -> None:
    """Make a manifest the newest one by a single rename."""
    draft, system = _hadoop_path(spark, f"{root}/manifest/_draft-{uuid.uuid4().hex}")
    out = system.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    place = _hadoop_path(spark, f"{root}/manifest/{number}.json")[0]
    if system.exists(place) or not system.rename(draft, place):
        raise RuntimeError(f"another writer has published version {number} of {root}")


def _remove_unlisted(spark: SparkSession, root: str, number: int) -> None:
    """Remove versions that neither the newest manifest nor number ``number`` before it refers to."""
    newest, _ = _manifest(spark, root)
    listed = list(newest["partitions"])
    before, system = _hadoop_path(spark, f"{root}/manifest/{number}.json")
    if system.exists(before):
        source = system.open(before)
        listed += json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)))["partitions"]
        source.close()
    used = {p["path"].rsplit("/version=", 1)[1].split("/", 1)[0] for p in listed}
    for kind, keep in (
        ("data", lambda name: name.removeprefix("version=") in used or int(name[8:].split("-")[0]) > number + 1),
        ("manifest", lambda name: name.startswith("_") or int(name[:-5]) >= number),
    ):
        place = _hadoop_path(spark, f"{root}/{kind}")[0]
        for status in system.listStatus(place) if system.exists(place) else []:
            if not keep(status.getPath().getName()):
                system.delete(status.getPath(), True)


def read_monthly(spark: SparkSession, root: str) -> DataFrame:
    """Read what ``write_monthly`` published last; partition filters prune folders."""
    manifest, number = _manifest(spark, root)
    if not number:
        raise FileNotFoundError(f"nothing was published at {root}")
    paths = [p["path"] for p in manifest["partitions"]]
    if paths:
        reader = spark.read.options(basePath=f"{root}/data", **VERIFY_CHECKSUMS)
        table = reader.parquet(*paths).drop("version")
    else:
        table = spark.createDataFrame([], T.StructType.fromJson(json.loads(manifest["schema"])))
    return table.withColumnsRenamed({"year": "file_year", "month": "file_month"})


def _finished(spark: SparkSession, path: str) -> bool:
    """True when a write to ``path`` was committed; an aborted one leaves no marker."""
    marker, system = _hadoop_path(spark, f"{path}/_SUCCESS")
    return system.exists(marker)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Materialise ``df`` at ``path`` unless that was done before, and read it back."""
    if not _finished(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
