"""Exact Jaccard join of word n-gram sets: size-banded tiles, bitmap bounds, exact intersection.

Equal sets form one class. Shingles get a global order, rare before frequent, and each
class is listed under its first ``n - ceil(t n) + 1`` shingles: two sets that reach the
threshold share one of them. The classes under a shingle make tiles by size band; in a
tile, sizes and then hashed parity bitmaps bound the overlap from above, and only pairs
that may still link are compared exactly. Large groups of near copies are joined first
through one centre each, so that tiles compare only classes not yet connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import slices, stored
from .components import components

WORDS = 5
BATCH_BYTES = 24 << 20
# Frequent shingles ordered last: at most so many, whatever the corpus.
FREQUENT = 50_000
# Copies in one batch from which a shingle is reported as frequent.
REPORTED = 8
# Hashes of a batch that are sorted at a time, about.
RANGE = 1 << 18
# Classes that one tile compares with one another.
TILE = 1024
# Rows of a frequent shingle are dealt over so many partitions each.
SALTS = 64
# Sets and groups a task remembers, to list equal ones once.
REMEMBERED = 200_000
# Bits of a bitmap for each shingle of its set, at least: wide enough to tell most pairs apart.
BITS_PER_SHINGLE = 2

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of an ASCII-lowered text."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    width = min(words, n)
    mixed = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        mixed = mixed * _STEP + hashes[k : n - width + 1 + k]
    mixed ^= mixed >> np.uint64(30)
    mixed *= _MIX[0]
    mixed ^= mixed >> np.uint64(27)
    mixed *= _MIX[1]
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Bit k is the parity of the shingles that hash to k; a power of two of bits, by the size."""
    width = max(64, 1 << max(0, BITS_PER_SHINGLE * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(value: int, size: int, to: int) -> int:
    """A bitmap of ``size`` bytes as one of ``to`` bytes: halves add up modulo two."""
    while size > to:
        size //= 2
        value = (value & ((1 << (8 * size)) - 1)) ^ (value >> (8 * size))
    return value


def may_link(a_size: int, a_bits: bytes, b_size: int, b_bits: bytes, percent: int) -> bool:
    """Whether the overlap can reach the threshold, by sizes and by bits that differ."""
    small, large = sorted((a_size, b_size))
    if 100 * small < percent * large:
        return False
    width = min(len(a_bits), len(b_bits))
    a = _folded(int.from_bytes(a_bits, "little"), len(a_bits), width)
    b = _folded(int.from_bytes(b_bits, "little"), len(b_bits), width)
    overlap = (a_size + b_size - (a ^ b).bit_count()) // 2
    return 100 * overlap >= percent * (a_size + b_size - overlap)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def _raw_texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _repeated(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``REPORTED`` sets or more hold, sorted, and their copies.

    Hashes are sorted range by range, in place, so that beside the sets only one range of
    them is held.
    """
    total = sum(map(len, sets))
    count = 1 << max(0, total // RANGE - 1).bit_length()
    edges = np.array([k * ((1 << 64) // count) for k in range(1, count)], np.uint64)
    bounds = [np.concatenate(([0], np.searchsorted(c, edges), [len(c)])).tolist() for c in sets] if count > 1 else []
    shingles, copies = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for k in range(count if total else 0):
        own = np.concatenate([c[at[k] : at[k + 1]] for c, at in zip(sets, bounds)] if bounds else sets)
        own.sort()
        # Equal hashes stand together: one reaches so far if the last of them is equal too.
        often = np.unique(own[REPORTED - 1 :][own[REPORTED - 1 :] == own[: max(0, len(own) - REPORTED + 1)]])
        shingles.append(often)
        copies.append(np.searchsorted(own, often, "right") - np.searchsorted(own, often, "left"))
    return np.concatenate(shingles), np.concatenate(copies)


def _often(sets: list[np.ndarray], names: np.ndarray):
    """Shingles that many sets of a batch hold: copies, the most typical holder and its share."""
    shingle, copies = _repeated(sets)
    share, places = np.zeros(len(sets)), []
    for k, held in enumerate(sets if len(shingle) else ()):
        at = np.searchsorted(shingle, held)
        at = at[shingle[np.minimum(at, len(shingle) - 1)] == held]
        places.append(at.astype(np.int32))
        share[k] = len(at) / max(1, len(held))
    # The holder with the largest share is written last, of equal ones the smallest name.
    first = np.zeros(len(shingle), np.int64)
    for k in np.lexsort((names, -share))[::-1].tolist() if places else ():
        first[places[k]] = k
    return shingle, copies, names[first], share[first]


def _describe(rows: DataFrame, words: int) -> DataFrame:
    """A row per document: set size, digest, bitmap; and rows of shingles frequent in a batch.

    ``e`` is half the digest of the document's set; for a frequent shingle, of the set
    among those holding it that has the largest share of frequent ones. In a group of
    near copies that is the one most like all others. Rows without id link with nothing
    and are not counted among them.
    """
    names = ["doc_id", "n", "cid", "bits", "shingle", "copies", "e", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                sizes, digests, bitmaps, seen, counted = [], [], [], {}, []
                for block in slices(part, 1):
                    for raw, named in zip(_raw_texts(block.column(1)), block.column(0).is_valid().to_pylist()):
                        found = shingle_set(raw, words)
                        digest = xxhash.xxh3_128_digest(found.tobytes())
                        sizes.append(len(found))
                        digests.append(digest)
                        bitmaps.append(parity_bitmap(found))
                        # A centre must be a set that takes part: one of a row with an id.
                        if named and digest not in seen:
                            seen[digest] = True
                            counted.append(found)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                        pa.array(bitmaps, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                        pa.array([_short(d) for d in digests], pa.int64()), pa.nulls(n, pa.float64()),
                    ],
                    names=names,
                )
                held = [_short(d) for d in seen]
                shingle, copies, centre, share = _often(counted, np.array(held, np.int64))
                m = len(shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(m, part.column(0).type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                        pa.nulls(m, pa.binary()), pa.array(shingle.view(np.int64)), pa.array(copies),
                        pa.array(centre), pa.array(share),
                    ],
                    names=names,
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n long, cid binary, bits binary, shingle long, copies long, e long, share double"
    )


def _listed(rows: DataFrame, frequent, words: int, percent: int) -> DataFrame:
    """Each distinct set of a task under the first shingles of its order.

    Frequent shingles are replaced by their centres: one row, with a salt, for all that
    share a centre. Sets that share a frequent shingle share its centre.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, copies, centre = frequent.value
        seen: set[bytes] = set()
        for batch in batches:
            for block in slices(batch, 1):
                keys, salts, owners, sizes = [], [], [], []
                for raw in _raw_texts(block.column(1)):
                    found = shingle_set(raw, words)
                    n = len(found)
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    if not n or digest in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    prefix = n - -(-percent * n // 100) + 1
                    at = np.minimum(np.searchsorted(hot, found), max(0, len(hot) - 1))
                    heavy = hot[at] == found if len(hot) else np.zeros(n, bool)
                    rare = found[~heavy][:prefix]
                    own = at[heavy]
                    own = own[np.argsort(copies[own], kind="stable")][: prefix - len(rare)]
                    hubs = np.unique(centre[own])
                    keys += [rare.view(np.int64), hubs]
                    salts += [np.full(len(rare), -1, np.int32), np.full(len(hubs), _short(digest) % SALTS, np.int32)]
                    owners.append(_short(digest))
                    sizes.append(len(rare) + len(hubs))
                if owners:
                    owner = np.repeat(np.array(owners, np.int64), sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.concatenate(salts)), pa.array(owner)],
                        names=["key", "salt", "e"],
                    )

    return rows.mapInArrow(run, "key long, salt int, e long")


def _shared(listed: DataFrame) -> DataFrame:
    """Groups of sets that share a key: group number, set, and a centre to compare first.

    Keys with the same sets make one group; a centre's group is given by the centre.
    Rows arrive sorted. What is held is one batch and the run that reaches into the next;
    a run of a rare key is short, a centre's rows need no holding.
    """
    names = ["g", "e", "centre"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        seen: set[int] = set()

        def settled(key, salt, e) -> pa.RecordBatch:
            new = np.append(True, (np.diff(key) != 0) | (np.diff(salt) != 0) | (np.diff(e) != 0))
            key, salt, e = key[new], salt[new], e[new]
            first = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(salt) != 0)))
            length = np.diff(np.append(first, len(key)))
            number = np.add.reduceat((e.view(np.uint64) ^ (e.view(np.uint64) >> np.uint64(31))) * _MIX[0], first)
            number = (number * _MIX[1] + length.astype(np.uint64)).view(np.int64)
            rare = salt[first] < 0
            _, once = np.unique(number, return_index=True)
            fresh = np.zeros(len(first), bool)
            fresh[once] = True
            fresh &= rare & (length > 1)
            for k in np.flatnonzero(fresh).tolist():
                if int(number[k]) in seen:
                    fresh[k] = False
                else:
                    seen.add(int(number[k]))
            if len(seen) > REMEMBERED:
                seen.clear()
            keep = np.repeat(fresh | ~rare, length)
            centre = np.repeat(np.where(rare, e[first], key[first]), length)
            group = np.repeat(np.where(rare, number, key[first]), length)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (group, e, centre)], names=names)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest:
                columns = [np.append(a, b) for a, b in zip(rest, columns)]
            key, salt = columns[0], columns[1]
            if not len(key):
                continue
            other = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
            last = len(key) if salt[-1] >= 0 else int(other[-1]) + 1 if len(other) else 0
            rest = [c[last:] for c in columns]
            if last:
                yield settled(*[c[:last] for c in columns])
        if rest and len(rest[0]):
            yield settled(*rest)

    dealt = listed.repartition("key", "salt").sortWithinPartitions("key", "salt", "e")
    return dealt.mapInArrow(run, "g long, e long, centre long").distinct()


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that sizes and bitmaps still allow to link."""
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("bits").alias("ab"))
    b = classes.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "an", "ab", "bn", "bb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            an, ab, bn, bb = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [may_link(p, q, r, s, percent) for p, q, r, s in zip(an, ab, bn, bb)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _texts(pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """A text of every class in the pairs, found by the id that stands for it.

    Rows under one id may differ, so the digest decides; a text found twice only
    repeats a pair.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    reps = stored(wanted.join(classes, "node").select("node", "cid", F.col("rep").alias("doc_id")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, 2):
                cids = block.column(1).to_pylist()
                same = [
                    xxhash.xxh3_128_digest(shingle_set(raw, words).tobytes()) == cid
                    for cid, raw in zip(cids, _raw_texts(block.column(2)))
                ]
                yield block.select([0, 2]).filter(pa.array(same, pa.bool_()))

    # One way for every size: a broadcast of the ids would pay on small inputs only.
    found = rows.join(reps.hint("shuffle_hash"), "doc_id").select("node", "cid", "text").mapInArrow(run, "node long, text string")
    return stored(found, "texts")


def _verified(
    pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, percent: int
) -> DataFrame:
    """The pairs whose sets reach the threshold, compared as sorted arrays.

    Texts travel instead of sets: they are half as large when compressed. A skewed
    centre is split by adaptive execution.
    """
    texts = _texts(pairs, classes, rows, words)
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("at"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("bt"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "at", "bt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, 2):
                held: dict[int, np.ndarray] = {}
                keep = []
                a, b = block.column(0).to_pylist(), block.column(1).to_pylist()
                for x, y, p, q in zip(a, b, _raw_texts(block.column(2)), _raw_texts(block.column(3))):
                    for node, raw in ((x, p), (y, q)):
                        if node not in held:
                            held[node] = shingle_set(raw, words)
                    keep.append(linked(held[x], held[y], percent))
                yield block.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return cut(both.mapInArrow(run, "a long, b long"))


def tile_pairs(nodes, roots, sizes, bitmaps, owns, blocks, band, block_pair, percent: int):
    """Pairs of a tile that may link and are not connected yet.

    Members are sorted by size; each meets the larger ones in reach of the threshold, and
    the bits in which their bitmaps differ bound the overlap from above.
    """
    order = sorted(range(len(nodes)), key=lambda k: (sizes[k], nodes[k]))
    width = min(len(bitmaps[k]) for k in order)
    folded = [
        _folded(int.from_bytes(bitmaps[k], "little"), len(bitmaps[k]), width).to_bytes(width, "little") for k in order
    ]
    bits = np.frombuffer(b"".join(folded), np.uint64).reshape(len(order), width // 8)
    node, root, size, own, block = (np.array([x[k] for k in order]) for x in (nodes, roots, sizes, owns, blocks))
    low, high = block_pair
    for i in range(len(order) - 1):
        end = int(np.searchsorted(size, 100 * size[i] // percent, side="right"))
        rest = slice(i + 1, end)
        # Two of the lower band meet in their own tile, two of one block in theirs.
        right = (root[rest] != root[i]) & (np.maximum(own[rest], own[i]) == band)
        right &= (np.minimum(block[rest], block[i]) == low) & (np.maximum(block[rest], block[i]) == high)
        at = i + 1 + np.flatnonzero(right)
        if len(at):
            differ = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
            overlap = (size[at] + size[i] - differ) // 2
            at = at[100 * overlap >= percent * (size[at] + size[i] - overlap)]
            yield from zip(np.minimum(node[at], node[i]).tolist(), np.maximum(node[at], node[i]).tolist())


def _tiled(near: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs not connected yet that share a group, lie in one or neighbouring bands and pass the bounds."""
    # Sizes that can link differ by less than one band.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    member = (
        near.select("g", "node", "n").distinct().join(roots, "node", "left")
        .select("g", "node", "n", F.coalesce("root", "node").alias("root"), band.alias("own"))
        .withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    )
    # Only tiles with members of the band itself and of two components are worth a look.
    tiles = member.groupBy("g", "band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"),
        F.max("own").alias("top"),
    ).where("low <> high AND top = band")
    blocks = F.ceil(F.col("members") / TILE).cast("int")
    rows = (
        member.join(tiles.select("g", "band", "members"), ["g", "band"])
        .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .join(classes.select("node", "bits"), "node")
        .select("g", "band", "i", "j", "node", "root", "n", "bits", "own", "block")
    )
    dealt = rows.repartition("g", "band", "i", "j").sortWithinPartitions("g", "band", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: list[tuple] = []
        found: set[tuple[int, int]] = set()

        def close() -> None:
            if len(tile) > 1:
                columns = list(zip(*tile))
                found.update(tile_pairs(*columns[4:10], tile[0][1], tile[0][2:4], percent))
            tile.clear()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if tile and row[:4] != tile[0][:4]:
                    close()
                    if len(found) >= 50_000:
                        yield pa.RecordBatch.from_arrays(_columns(found), names=["a", "b"])
                        found.clear()
                tile.append(row)
        close()
        yield pa.RecordBatch.from_arrays(_columns(found), names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _columns(pairs: set[tuple[int, int]]) -> list[pa.Array]:
    flat = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return [pa.array(flat[:, 0]), pa.array(flat[:, 1])]


def _frequent(spark: SparkSession, described: DataFrame):
    """The most frequent shingles, their copies and a set holding each: at most ``FREQUENT``."""
    top = (
        described.where("shingle IS NOT NULL").groupBy("shingle")
        .agg(F.sum("copies").alias("copies"), F.max_by("e", F.struct("share", "e")).alias("centre"))
        .orderBy(F.desc("copies"), "shingle").limit(FREQUENT).toArrow()
    )
    shingle, copies, centre = (np.asarray(top.column(k).to_numpy()) for k in range(3))
    shingle = shingle.astype(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return spark.sparkContext.broadcast((shingle[order], copies[order], centre[order]))


def jaccard_components(
    docs: DataFrame, percent: int = 75, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    Words are runs without white space, A-Z lowered. A text with fewer words than a
    shingle is one shingle; a null, empty or blank text has none and links with
    nothing. Two documents link when ``100 * shared >= percent * union``, with
    ``percent`` from 1; ``component_id`` is the smallest id reachable. Repeated rows
    stay repeated, rows with a null id get a null component of their own and link
    nothing, other columns are not read. Shingles are compared by 64-bit hashes, whole
    sets by a 128-bit digest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    described = stored(_describe(rows, words), "described")
    known = described.where("shingle IS NULL")
    numbered = known.where("doc_id IS NOT NULL AND n > 0")
    classes = stored(
        numbered.groupBy("cid").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"),
            F.first("e").alias("e"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    listed = _listed(rows.where("doc_id IS NOT NULL"), _frequent(spark, described), words, percent)
    # A set is listed by half its digest; should two share it, both take part.
    half = classes.select("e", "node", "n")
    centre = classes.select(F.col("e").alias("centre"), F.col("node").alias("to"), F.col("n").alias("to_n"))
    near = stored(_shared(listed).join(half, "e").join(centre, "centre").drop("e", "centre"), "near")
    fits = (100 * F.least("n", "to_n") >= percent * F.greatest("n", "to_n")) & (F.col("node") != F.col("to"))
    stars = near.where(fits).select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()
    first = _verified(stored(_bounded(stars, classes, percent), "stars"), classes, rows, words, percent)
    rest = stored(_tiled(near, classes, components(first), percent), "tiles")
    links = first.union(_verified(rest, classes, rows, words, percent))
    joined = components(links)
    named = classes.join(joined, "node", "left").select("cid", "rep", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    member = named.join(smallest, "root").select("cid", "component_id")
    return (
        known.join(member, "cid", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )
