"""Exact, repeatable, stratified sampling by hash order.

A row's place in the sample order is the hash of its key, so the same rows are
drawn on every run and after a lost task. A histogram of hash prefixes per stratum,
which also gives the sizes of the strata, says which prefix a cut falls into. A second
reading keeps the rows up to that prefix, and only the rows of that one prefix are
ordered; no stratum is ever sorted or ranked as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FILE_KEYS
from ..session import cut, settle
from ..sources.trips import file_row_counts

_PREFIX_DIGITS = 4
_AFTER_ALL = "g"  # sorts after every hexadecimal digit
_CHUNK = 100_000


def row_key(df: DataFrame, key=None) -> list[str]:
    """Columns that identify a row: given ones, file position, else all columns."""
    if key:
        return list(key)
    if {"source_file", "source_row"} <= set(df.columns):
        return [*[k for k in FILE_KEYS if k in df.columns], "source_file", "source_row"]
    return list(df.columns)


def sample_order(key: list[str], seed: int) -> Column:
    """Hash of seed and key. Every part carries its length, an unknown one a mark of its own."""
    parts = [
        F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        for text in (F.col(f"`{k}`").cast("string") for k in key)
    ]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def sample_allocation(trips: DataFrame, total: int) -> DataFrame:
    """Rows to draw per file: by cab type first, then by month within it.

    ``trips`` has a row per trip, or counts in ``rows`` as ``hash_histogram`` has.
    """
    counts = file_row_counts(trips)
    type_share = F.col("type_rows") / F.col("overall_rows")
    type_n = F.greatest(F.floor(type_share * F.lit(float(total))), F.lit(1))
    file_n = F.floor(F.col("file_rows") / F.col("type_rows") * F.col("type_take").cast("double"))
    return counts.withColumn("type_take", type_n).select(
        *FILE_KEYS, "file_rows", "type_rows", "type_take",
        F.least(file_n, F.col("file_rows")).alias("take"),
    )


def hash_histogram(df: DataFrame, by, key=None, seed: int = 42) -> DataFrame:
    """Rows per stratum and hash prefix, combined before they travel and kept for several uses."""
    return cut(
        _hashed(df, row_key(df, key), seed).groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("rows"))
    )


def _hashed(df: DataFrame, identity: list[str], seed: int) -> DataFrame:
    order = sample_order(identity, seed)
    return df.withColumn("_h", order).withColumn("_p", F.substring("_h", 1, _PREFIX_DIGITS))


def take_by_hash(
    df: DataFrame, sizes: DataFrame, by, key=None, seed: int = 42, histogram: DataFrame | None = None
) -> DataFrame:
    """Exactly ``take`` rows per stratum (all rows if it has fewer).

    ``sizes`` has ``by`` and ``take``; strata without a row or with 0 are left out.
    ``df`` is read once, and once more before that where its ``hash_histogram`` is not
    at hand. What may be in the sample is written to the shared folder: the sample
    itself and, per stratum, one hash prefix in 65,536.
    """
    by = list(by)
    identity = row_key(df, key)
    if histogram is None:
        histogram = hash_histogram(df, by, key, seed)
    hashed = _hashed(df, identity, seed)

    running = (
        Window.partitionBy(*by).orderBy("_p")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    prefixes = (
        histogram.withColumnRenamed("rows", "_m")
        .withColumn("_upto", F.sum("_m").over(running))
        .withColumn("_size", F.sum("_m").over(Window.partitionBy(*by)))
        .join(sizes.where("take > 0").select(*by, "take"), by)
    )
    # The prefix the cut falls into; strata drawn whole need none.
    before = F.col("_upto") - F.col("_m")
    partial = F.col("take") < F.col("_size")
    edges = settle(
        prefixes.where((~partial & (F.col("_upto") == F.col("_size")))
                       | (partial & (before < F.col("take")) & (F.col("take") <= F.col("_upto"))))
        .select(*by, F.when(partial, F.col("_p")).alias("_edge"), (F.col("take") - before).alias("_need"))
    )
    within = (
        Window.partitionBy(*by).orderBy("_h")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto_edge = F.col("_edge").isNull() | (F.col("_p") <= F.col("_edge"))
    candidates = cut(hashed.join(edges, by).where(upto_edge))
    stops = settle(
        candidates.where(F.col("_p") == F.col("_edge"))
        .groupBy(*by, "_h", "_need").agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_upto", F.sum("_copies").over(within))
        .withColumn("_left", F.col("_need") - F.col("_upto") + F.col("_copies"))
        .where((F.col("_left") > 0) & (F.col("_left") <= F.col("_copies")))
        .select(*by, F.col("_h").alias("_stop"), "_left", "_copies")
    )
    limits = settle(
        edges.join(stops, by, "left").select(
            *by, F.coalesce("_stop", F.lit(_AFTER_ALL)).alias("_stop"),
            F.coalesce("_left", F.lit(0)).alias("_left"),
            (F.col("_left") < F.col("_copies")).alias("_split"),
        )
    )
    drawn = candidates.drop("_need").join(limits, by)
    if limits.where("_split").isEmpty():
        return drawn.where(F.col("_h") <= F.col("_stop")).select(df.columns)
    surely = drawn.where((F.col("_h") < F.col("_stop"))
                         | (~F.coalesce("_split", F.lit(False)) & (F.col("_h") == F.col("_stop"))))
    tied = drawn.where(F.col("_split") & (F.col("_h") == F.col("_stop")))
    if set(df.columns) <= {*identity, *by}:
        some = _some_copies(tied, df.columns)
    else:
        # Different rows under one key: the same draw again, by all columns.
        sizes = limits.where("_split").select(*by, F.col("_left").alias("take"))
        some = take_by_hash(tied.select(df.columns), sizes, by, df.columns, seed)
    return surely.select(df.columns).unionByName(some.select(df.columns))


def _some_copies(tied: DataFrame, columns) -> DataFrame:
    """``_left`` copies of identical rows, made from one counted row in chunks."""
    one = tied.groupBy(*columns, "_left").agg(F.lit(0).alias("_z"))
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_left") - 1) / _CHUNK))
    spread = one.withColumn("_c", F.explode(chunks)).repartition("_c")
    size = F.least(F.lit(_CHUNK).cast("bigint"), F.col("_left") - F.col("_c") * _CHUNK)
    return spread.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))


def sample_stratified(trips: DataFrame, total: int, key=None, seed: int = 42) -> DataFrame:
    """Exact per-file samples by the proportional allocation."""
    histogram = hash_histogram(trips, FILE_KEYS, key, seed)
    return take_by_hash(trips, settle(sample_allocation(histogram, total)), FILE_KEYS, key, seed, histogram)


def sample_total(df: DataFrame, n: int, key=None, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows of the whole frame, all if it has fewer."""
    whole = df.withColumn("_stratum", F.lit(0))
    sizes = df.sparkSession.range(1).select(
        F.lit(0).alias("_stratum"), F.lit(n).cast("bigint").alias("take")
    )
    return take_by_hash(whole, sizes, ["_stratum"], row_key(df, key), seed).drop("_stratum")


def sample_all_cabs(
    trips: DataFrame, total: int = 10_000_000, key=None, seed: int = 42
) -> DataFrame:
    """Proportional sample over all cab types, cut to ``total`` rows if it came out larger.

    It can only be larger when rounding small cab types up to one row adds some.
    """
    histogram = hash_histogram(trips, FILE_KEYS, key, seed)
    sizes = settle(sample_allocation(histogram, total))
    drawn = take_by_hash(trips, sizes, FILE_KEYS, key, seed, histogram)
    planned = sizes.agg(F.sum("take")).first()[0] or 0
    return sample_total(drawn, total, key, seed) if planned > total else drawn


def sample_year(
    trips: DataFrame, cab_type: str = "yellow", year: int = 2024, total: int = 100_000,
    key=None, seed: int = 42,
) -> DataFrame:
    """Proportional sample of one cab type's year."""
    mine = trips.where((F.col("cab_type") == cab_type) & (F.col("file_year") == year))
    return sample_stratified(mine, total, key, seed)


def pick_file(trips: DataFrame, seed: int = 42) -> DataFrame:
    """Trips of one file, chosen by hash order of the file keys."""
    files = trips.groupBy(*FILE_KEYS).agg(F.count(F.lit(1)).alias("_rows"))
    first = settle(files.orderBy(sample_order(list(FILE_KEYS), seed)).limit(1).drop("_rows"))
    return trips.join(first, list(FILE_KEYS), "left_semi")


def sample_n(
    trips: DataFrame, n: int = 500, key=None, seed: int = 42, strict: bool = False
) -> DataFrame:
    """``n`` rows of one randomly picked file; ``strict`` refuses a file with fewer."""
    one = pick_file(trips, seed)
    if strict:
        found = one.count()
        if found < n:
            raise ValueError(f"cannot draw {n} rows from a file of {found}")
    return sample_total(one, n, key, seed)
