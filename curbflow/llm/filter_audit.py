"""What each of five filters removes, alone and in every order, with exact duplicates among them.

Duplicates take a prepass: counting Bloom sketches of all texts are merged, and a text that
meets a cell counted once is certainly unique. Only possible repeats are shuffled, for the
exact smallest id per full text. Every document ends as a mask of the filters it fails, and
all 120 orders are read off counts of masks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts_of

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")

# Cells of the sketch per document, and the most it may have: two bits each, 64 MB in all.
CELLS_PER_DOC = 8
MAX_CELLS = 1 << 28
# Cells of one shard; a shard is merged in one task.
SHARD_CELLS = 1 << 20
# Cells counted for each text.
PROBES = 4
# A text that more than one row in this many holds is a hot one; there are fewer such texts.
HOT_SHARE = 1_000

UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOL = re.compile(rb"[#$%&*|]")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _cells(digests: list[bytes], cells: int) -> np.ndarray:
    """The cells of each text: one row of ``PROBES`` per digest. ``cells`` is a power of two."""
    halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) & np.uint64(cells - 1)).astype(np.int64)


def _pack(counts: np.ndarray) -> bytes:
    """Four counts of 0 to 2 per byte."""
    four = counts.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


class Sketch:
    """A merged counting Bloom sketch, read only."""

    def __init__(self, packed: bytes, cells: int):
        self.cells = cells
        self.packed = np.frombuffer(packed, np.uint8)

    def may_repeat(self, digests: list[bytes]) -> np.ndarray:
        """False where some cell was counted once only: no other row has this text."""
        at = _cells(digests, self.cells)
        counts = self.packed[at >> 2] >> ((at & 3) << 1).astype(np.uint8) & 3
        return (counts >= 2).all(axis=1)


def sketch_size(rows: int) -> int:
    """Cells for so many documents: a power of two, a shard at least and ``MAX_CELLS`` at most."""
    return min(MAX_CELLS, max(SHARD_CELLS, 1 << max(0, CELLS_PER_DOC * rows - 1).bit_length()))


def merged_sketch(docs: DataFrame, id_col: str, text_col: str) -> Sketch:
    """Counts of all texts with an id, saturated at two.

    Every Arrow block leaves its touched cells only; shards of cells are added up in
    tasks and arrive packed, at most ``MAX_CELLS / 4`` bytes. Beyond ``MAX_CELLS`` more
    documents count as possible repeats, and the result stays the same.
    """
    identified = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    cells = sketch_size(identified.count())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(t) for block in slices(batch, 0) for t in texts_of(block.column(0))]
            if not digests:
                continue
            # A cell that two probes of one text share counts once for that text.
            own = np.sort(_cells(digests, cells), axis=1)
            fresh = np.ones(own.shape, bool)
            fresh[:, 1:] = own[:, 1:] != own[:, :-1]
            touched, counts = np.unique(own[fresh], return_counts=True)
            shard = touched // SHARD_CELLS
            cuts = np.flatnonzero(np.diff(shard)) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[np.append(0, cuts)].astype(np.int32)),
                    pa.array([(p % SHARD_CELLS).astype("<u4").tobytes() for p in np.split(touched, cuts)], pa.binary()),
                    pa.array([np.minimum(p, 2).astype(np.uint8).tobytes() for p in np.split(counts, cuts)], pa.binary()),
                ],
                names=["shard", "cells", "counts"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(number: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([_pack(total)], pa.binary())], names=["shard", "packed"]
            )

        now, total = None, None
        for batch in batches:
            for number, at, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now:
                    if total is not None:
                        yield packed(now, total)
                    now, total = number, np.zeros(SHARD_CELLS, np.uint8)
                at = np.frombuffer(at, "<u4")
                total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
        if total is not None:
            yield packed(now, total)

    shards = (
        identified.mapInArrow(partial, "shard int, cells binary, counts binary")
        .repartition("shard").sortWithinPartitions("shard")
        .mapInArrow(merge, "shard int, packed binary")
        .toArrow()
    )
    size = SHARD_CELLS // 4
    whole = bytearray(cells // 4)
    for number, part in zip(shards["shard"].to_pylist(), shards["packed"].to_pylist()):
        whole[number * size : (number + 1) * size] = part
    return Sketch(bytes(whole), cells)


def own_faults(text: str) -> int:
    """Mask of the filters A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly space and tab to carriage return
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * upper > 5 * len(text)) << 2
        | (SYMBOL.search(raw) is not None) << 3
    )


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per document: ``doc_id``, ``part``, ``mask`` of A to D, ``digest`` and ``text``.

    The last two are null for a document whose text is certainly unique.
    """
    spark = docs.sparkSession
    sketch = merged_sketch(docs, id_col, text_col)
    held = spark.sparkContext.broadcast((sketch.packed.tobytes(), sketch.cells))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = Sketch(*held.value)
        for batch in batches:
            for block in slices(batch, 2):
                texts = texts_of(block.column(2))
                digests = [_digest(t) for t in texts]
                again = merged.may_repeat(digests) & block.column(0).is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column(0), block.column(1),
                        pa.array([own_faults(t) for t in texts], pa.int32()),
                        pa.array([d if a else None for d, a in zip(digests, again)], pa.binary()),
                        pa.array([t if a else None for t, a in zip(texts, again)], pa.string()),
                    ],
                    names=["doc_id", "part", "mask", "digest", "text"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary, text string")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` (bit k: filter k of ABCDE fails) of every row."""
    rows = stored(judged(docs, id_col, text_col, part_col), "audit")
    repeats = rows.where("text IS NOT NULL")
    # Copies meet by their full text, combined before the shuffle.
    smallest = stored(
        repeats.groupBy("digest", "text").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1").select("digest", "_least", "_copies"),
        "smallest",
    )
    # Fewer than HOT_SHARE texts can hold more than one row in HOT_SHARE: a proven bound.
    total = smallest.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    hot = F.col("_copies") * HOT_SHARE > total
    slim = repeats.select("doc_id", "part", "mask", "digest")
    few = F.broadcast(smallest.where(hot).select("digest", "_least"))
    crowded = slim.join(few, "digest")
    others = slim.join(few, "digest", "left_anti").join(
        smallest.where(~hot).select("digest", "_least"), "digest", "left"
    )
    later = F.when(F.col("doc_id") > F.col("_least"), F.lit(DUPLICATE)).otherwise(F.lit(0))
    repeated = crowded.unionByName(others).select("doc_id", "part", (F.col("mask") + later).alias("mask"))
    return rows.where("text IS NULL").select("doc_id", "part", "mask").unionByName(repeated)


def _orders() -> tuple[list[str], list[int], list[int]]:
    """Every order, and for each of its steps the filters before it and its own bit, as masks."""
    names, before, own = ["".join(p) for p in permutations(FILTERS)], [], []
    for name in names:
        bits = [1 << FILTERS.index(letter) for letter in name]
        before += [sum(bits[:k]) for k in range(len(bits))]
        own += bits
    return names, before, own


def interactions(mask_counts: DataFrame) -> DataFrame:
    """The audit from ``part``, ``mask``, ``n``, ``good`` and ``toxic`` counts, which add up.

    ``_free[m]`` is the number of documents that fail no filter of the mask ``m``;
    whatever an order removes or keeps is a difference of two such numbers.
    """
    subsets = range(1 << len(FILTERS))

    def free(name: str) -> Column:
        sums = [F.sum(F.when(F.col("mask").bitwiseAND(m) == 0, F.col(name)).otherwise(0)) for m in subsets]
        return F.array(*sums).alias(f"_{name}")

    alone = F.array(*[F.sum(F.when(F.col("mask") == m, F.col("n")).otherwise(0)) for m in subsets]).alias("_alone")
    names, before, own = _orders()
    steps = len(FILTERS)
    lines = (
        mask_counts.groupBy("part").agg(free("n"), free("good"), free("toxic"), alone)
        .select("*", F.posexplode(F.lit(before)).alias("_line", "_before"))
        .withColumn("_own", F.element_at(F.lit(own), F.col("_line") + 1))
        .withColumn("_upto", F.col("_before") + F.col("_own"))
    )

    def at(name: str, mask: Column) -> Column:
        return F.element_at(f"_{name}", mask + 1)

    def removed(name: str) -> Column:
        return at(name, F.col("_before")) - at(name, F.col("_upto"))

    def over_all_orders() -> Column:
        """An order puts the set ``s`` before a filter in |s|! (4 - |s|)! ways."""
        cases = []
        for bit in (1 << k for k in range(steps)):
            terms = [
                (F.col("_n")[s] - F.col("_n")[s | bit])
                * (math.factorial(s.bit_count()) * math.factorial(steps - 1 - s.bit_count()))
                for s in subsets if not s & bit
            ]
            cases.append(sum(terms[1:], terms[0]))
        return F.array(*cases)

    return lines.select(
        "part",
        F.element_at(F.lit(names), F.expr(f"_line div {steps}").cast("int") + 1).alias("filter_order"),
        (F.col("_line") % steps + 1).cast("int").alias("step"),
        at("n", F.col("_upto")).alias("kept"),
        removed("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", F.col("_own")) - removed("n")).alias("redundant"),
        F.element_at("_alone", F.col("_own") + 1).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.element_at(over_all_orders(), F.log2("_own").cast("int") + 1).alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """Per part, order of the filters and step: documents kept, removed and lost.

    Null texts and parts count as empty. A row without id has no smaller id and is no
    smaller id; rows that repeat an id and its text are not each other's duplicates.
    Every row counts, repeated ones as often as they occur. Labels are looked up by id;
    an id labelled more than once is good or toxic if any of its labels says so. Columns
    other than the three named are not read. A table without rows has no parts. A lost
    task reads stored rows again.
    """
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"),
    )
    # Combined per id before the join, so an id of many rows meets its label once per kind.
    counted = masks(docs, id_col, text_col, part_col).groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    with_labels = counted.join(marked, F.col("doc_id") == F.col("_doc_id"), "left")
    sums = with_labels.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("_good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("_toxic", F.lit(0))).alias("toxic"),
    )
    return interactions(sums)


def oracle_sql() -> str:
    """The same audit for DuckDB, document by document and order by order."""
    letters = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(FILTERS))
    order = " || ".join(f"f{k}.c" for k in range(1, 6))
    distinct = " AND ".join(f"f{i}.c <> f{j}.c" for i in range(1, 6) for j in range(1, i))
    froms = ", ".join(f"f f{k}" for k in range(1, 6))
    steps = " UNION ALL ".join(
        f"SELECT {order} AS filter_order, {k} AS step, f{k}.b AS own, "
        f"{' + '.join([f'f{j}.b' for j in range(1, k)] or ['0'])} AS earlier FROM {froms} WHERE {distinct}"
        for k in range(1, 6)
    )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w
), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN marked USING (doc_id) GROUP BY part, mask
), f(c, b) AS (VALUES {letters}), orders AS ({steps}), a AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (earlier + own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, orders GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM a"""
