"""Nearest neighbours by cosine with a vantage-point tree per shard.

Distinct vectors are dealt to shards of bounded size; each shard becomes a tree over
unit vectors, where the chord length is a metric with the order of the cosine. Blocks
of queries visit every tree: a task holds a few blocks, its trees pass by one after
another and what one tree gave bounds the visit of the next. A subtree is skipped when
the triangle inequality, its margin multiplied by ``factor``, rules it out: factor 1 is
exact, less skips more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored

SHARD_VECTORS = 8192
# Tasks that the meetings of blocks and trees are dealt to at most; each takes several in turn.
MEETING_PARTITIONS = 20_000
BLOCK_QUERIES = 2048
# Blocks that a task holds while its trees pass by, and trees that pass at least where there are as many.
BLOCKS_HELD = 16
TREES_PASSED = 4
LEAF = 64
# Neighbours a search keeps beyond those asked for; they set the bound for the exact visit.
SPARE = 8
# Room for rounding when chords decide what exact scores compare.
SLACK = 1e-6
# Pairs scored exactly at a time.
PAIRS = 8192


class Tree:
    """Nodes in arrays: vantage point, radius of the inner half, two children or a leaf's range."""

    def __init__(self, unit: np.ndarray, seed: int = 5):
        self.unit = unit
        self.order = np.arange(len(unit))
        self.nodes: list[tuple[int, float, int, int, int, int]] = []
        chance = np.random.default_rng(seed)
        stack = [(0, len(unit), -1, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            at = len(self.nodes)
            if parent >= 0:
                held = list(self.nodes[parent])
                held[2 + side] = at
                self.nodes[parent] = tuple(held)
            if end - start <= LEAF:
                self.nodes.append((-1, 0.0, -1, -1, start, end))
                continue
            own = self.order[start:end]
            point = int(own[chance.integers(len(own))])
            far = chords(unit[own], unit[point : point + 1])[:, 0]
            middle = len(own) // 2
            parts = np.argpartition(far, middle)
            self.order[start:end] = own[parts]
            self.nodes.append((point, float(far[parts[middle]]), -1, -1, start, end))
            stack += [(start, start + middle, at, 0), (start + middle, end, at, 1)]

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest positions found per query, unused places -1, and their chords."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1)
        everyone = np.arange(len(queries))
        # First down to each query's own leaf, for a bound to begin with.
        stack, homes = [(0, everyone)], np.empty(len(queries), int)
        while stack:
            at, who = stack.pop()
            point, radius, inner, outer, start, end = self.nodes[at]
            if point < 0:
                homes[who] = at
                self._visit(queries, who, start, end, best, found)
                continue
            inside = chords(queries[who], self.unit[point : point + 1])[:, 0] < radius
            stack += [(n, w) for n, w in ((inner, who[inside]), (outer, who[~inside])) if len(w)]
        stack = [(0, everyone)]
        while stack:
            at, who = stack.pop()
            point, radius, inner, outer, start, end = self.nodes[at]
            if point < 0:
                who = who[homes[who] != at]
                if len(who):
                    self._visit(queries, who, start, end, best, found)
                continue
            gap = chords(queries[who], self.unit[point : point + 1])[:, 0] - radius
            reach = best[who, -1] * factor + 1e-9
            stack += [(n, w) for n, w in ((inner, who[gap <= reach]), (outer, who[-gap <= reach])) if len(w)]
        return found, best

    def within(self, queries: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of query and position whose chord is within the query's reach, leaf by leaf."""
        stack = [(0, np.arange(len(queries)))]
        while stack:
            at, who = stack.pop()
            point, radius, inner, outer, start, end = self.nodes[at]
            if point < 0:
                members = self.order[start:end]
                q, place = np.nonzero(chords(queries[who], self.unit[members]) <= reach[who][:, None])
                if len(q):
                    yield who[q], members[place]
                continue
            gap = chords(queries[who], self.unit[point : point + 1])[:, 0] - radius
            stack += [(n, w) for n, w in ((inner, who[gap <= reach[who]]), (outer, who[-gap <= reach[who]])) if len(w)]

    def _visit(self, queries, who, start, end, best, found) -> None:
        members = self.order[start:end]
        k = best.shape[1]
        far = chords(queries[who], self.unit[members])
        nearer = (far < best[who, -1:]).any(axis=1)  # the others keep what they have
        who, far = who[nearer], far[nearer]
        far = np.concatenate([best[who], far], axis=1)
        names = np.concatenate([found[who], np.broadcast_to(members, (len(who), len(members)))], axis=1)
        nearest = np.argsort(far, axis=1, kind="stable")[:, :k]
        best[who] = np.take_along_axis(far, nearest, axis=1)
        found[who] = np.take_along_axis(names, nearest, axis=1)


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, terms added in order: equal rows give equal scores."""

    def dot(x, y):
        return np.cumsum(x * y, axis=1)[:, -1]

    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


class Best:
    """Per query the ``k`` best candidates: highest score, then smallest id."""

    def __init__(self, wanted: np.ndarray, names: list, raw: np.ndarray, ids: list[list], k: int):
        self.wanted, self.raw, self.k = wanted, raw, k
        self.ids = sorted({i for own in ids for i in own})
        rank = {i: r for r, i in enumerate(self.ids)}
        self.own = np.array([rank.get(i, -1) for i in names])
        self.count = np.array([len(own) for own in ids])
        self.first = np.cumsum(self.count) - self.count
        self.rank = np.array([rank[i] for own in ids for i in own])
        self.score = np.full((len(names), k), -np.inf)
        self.held = np.full((len(names), k), -1)

    def add(self, who: np.ndarray, place: np.ndarray) -> None:
        """Candidates not added before, as pairs of query and position."""
        for at in range(0, len(who), PAIRS):
            self._merge(who[at : at + PAIRS], place[at : at + PAIRS])

    def _merge(self, who, place) -> None:
        score = cosines(self.wanted[who], self.raw[place])
        keep = score >= self.score[who, -1]
        who, place, score = who[keep], place[keep], score[keep]
        times = self.count[place]
        flat = np.arange(times.sum()) + np.repeat(self.first[place] - (np.cumsum(times) - times), times)
        who, score, rank = np.repeat(who, times), np.repeat(score, times), self.rank[flat]
        other = rank != self.own[who]
        touched, row = np.unique(who[other], return_inverse=True)
        if not len(touched):
            return
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), row])
        score = np.concatenate([self.score[touched].ravel(), score[other]])
        rank = np.concatenate([self.held[touched].ravel(), rank[other]])
        order = np.lexsort((rank, -score, row))
        row, score, rank = row[order], score[order], rank[order]
        start = np.searchsorted(row, np.arange(len(touched)))
        best = (start[:, None] + np.arange(self.k)).ravel()
        self.score[touched] = score[best].reshape(-1, self.k)
        self.held[touched] = rank[best].reshape(-1, self.k)


def best_of(
    tree: Tree, unit: np.ndarray, wanted: np.ndarray, names: list, raw: np.ndarray, ids: list[list], k: int, factor: float,
    floor: np.ndarray,
) -> Best:
    """The ``k`` best of a tree per query. With factor 1, all within the bound of the k-th are compared, ties of any number.

    ``floor`` is the score of the k-th found in other trees, -inf where there are fewer:
    with factor 1 what falls below it may be left out.
    """
    best = Best(wanted, names, raw, ids, k)
    bare = np.arange(len(unit)) if factor < 1 else np.nonzero(np.isneginf(floor))[0]
    if len(bare):
        found, _ = tree.search(unit[bare], k + 1 + SPARE, factor)
        who, at = np.nonzero(found >= 0)
        best.add(bare[who], found[who, at])
    if factor < 1:
        return best
    # Fewer than k, as where a query's own id takes the places: everything is in reach.
    bound = np.maximum(np.maximum(best.score[:, -1], floor), -1.0)
    best = Best(wanted, names, raw, ids, k)
    for who, place in tree.within(unit, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * bound)) + SLACK):
        best.add(who, place)
    return best


class Found:
    """Per query of a block the ``k`` best over the trees met so far: highest score, then smallest id."""

    def __init__(self, names: list, k: int):
        self.names, self.k = names, k
        self.pairs: list[list[tuple]] = [[] for _ in names]
        self.floor = np.full(len(names), -np.inf)

    def add(self, best: Best) -> None:
        for q in np.nonzero(best.held[:, 0] >= 0)[0].tolist():
            more = [(-s, best.ids[r]) for s, r in zip(best.score[q].tolist(), best.held[q].tolist()) if r >= 0]
            self.pairs[q] = sorted(self.pairs[q] + more)[: self.k]
            if len(self.pairs[q]) == self.k:
                self.floor[q] = -self.pairs[q][-1][0]


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """Not null or empty, every component a finite number, and not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0)


def _build(rows: DataFrame, keep: int) -> tuple[DataFrame, int]:
    """One row per shard with its tree, and the number of shards; equal vectors share a place.

    Of equal vectors the ``keep`` smallest ids are listed: no query can need more.
    """
    first = Window.partitionBy("vector").orderBy("id")
    few = rows.distinct().withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= keep)
    single = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    single = stored(single, "vectors")
    shards = max(1, -(-single.count() // SHARD_VECTORS))
    dealt = single.withColumns(
        {"dim": F.size("vector"), "shard": F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")}
    )

    def run(key, group):
        dim = key[0].as_py()
        group = group.combine_chunks()
        raw = _matrix(group["vector"], dim)
        order = np.lexsort(raw.T[::-1])  # the same tree whatever order the rows came in
        raw = raw[order]
        ids = [group["ids"][int(i)].as_py() for i in order]
        tree = Tree(raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True)))
        given = group["vector"].type.value_type.to_pandas_dtype()
        blob = pickle.dumps((raw.astype(given), ids, tree.order, tree.nodes))
        return pa.table({"dim": [dim], "shard": [key[1].as_py()], "tree": [blob]}, schema=pa.schema(
            [("dim", pa.int32()), ("shard", pa.int32()), ("tree", pa.binary())]
        ))

    trees = dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, tree binary")
    return stored(trees, "trees"), shards


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` nearest rows.

    Score is the cosine of the original vectors in double precision; nearest first,
    ties to the smaller id, own id excluded, all candidates if there are fewer than
    ``k``. Null, empty, zero and non-finite vectors and null ids take no part, and only
    vectors of one length are compared. Equal rows count once; an id with several
    vectors is several candidates and several queries. ``factor`` 1 finds the exact
    neighbours; below 1 the search is faster and may miss some.
    """

    def clean(df: DataFrame) -> DataFrame:
        # Floats stay as they are until they are scored: half the bytes to shuffle and store.
        kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
        chosen = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector"))
        return chosen.where(F.col("id").isNotNull() & usable(F.col("vector")))

    trees, shards = _build(clean(vectors), k + 1)
    asked = clean(queries).distinct()
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    dealt = asked.withColumns(
        {"dim": F.size("vector"), "block": F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")}
    )

    def gather(key, group):
        raw = _matrix(group["vector"], key[0].as_py())
        blob = pickle.dumps((group["id"].to_pylist(), raw))
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "asked": [blob]}, schema=pa.schema(
            [("dim", pa.int32()), ("block", pa.int32()), ("asked", pa.binary())]
        ))

    # Stored, so that places in a block stay the same whenever a task reads it again.
    bundles = stored(dealt.groupBy("dim", "block").applyInArrow(gather, "dim int, block int, asked binary"), "asked")
    # Every tree meets every block in some task, without copies of them in a shuffle. Tasks grow with shards, not with pairs.
    parts = max(1, -(-blocks // BLOCKS_HELD))
    sides = min(-(-shards // max(parts, TREES_PASSED)), max(1, MEETING_PARTITIONS // parts))
    standing = bundles.repartitionById(parts, F.col("block") % parts)
    passing = trees.repartitionById(sides, F.col("shard") % sides)
    meetings = passing.hint("shuffle_replicate_nl").join(standing, "dim")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Found] = {}
        last = None
        for batch in batches:
            columns = [batch.column(c) for c in ("dim", "shard", "block", "tree", "asked")]
            for row in range(batch.num_rows):
                dim, shard, block = (c[row].as_py() for c in columns[:3])
                if last != (dim, shard):
                    raw, ids, order, nodes = pickle.loads(columns[3][row].as_buffer())
                    raw = raw.astype(np.float64)
                    tree = Tree.__new__(Tree)
                    tree.unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
                    tree.order, tree.nodes = order, nodes
                    last = dim, shard
                names, wanted = pickle.loads(columns[4][row].as_buffer())
                unit = wanted / np.sqrt((wanted * wanted).sum(axis=1, keepdims=True))
                if (dim, block) not in held:
                    held[dim, block] = Found(names, k)
                found = held[dim, block]
                found.add(best_of(tree, unit, wanted, names, raw, ids, k, factor, found.floor))
        for (dim, block), found in held.items():
            rows = [(dim, block, at, found.names[at], i, -s) for at, own in enumerate(found.pairs) for s, i in own]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], places + ["query_id", "vec_id", "score"])

    asks, given = asked.schema["id"].dataType, vectors.schema[id_col].dataType
    places = ["dim", "block", "at"]
    kinds = [pa.int32()] * 3 + [to_arrow_type(asks), to_arrow_type(given), pa.float64()]
    hits = meetings.mapInArrow(
        search, f"dim int, block int, at int, query_id {asks.simpleString()}, vec_id {given.simpleString()}, score double"
    )
    order = Window.partitionBy(*places).orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def oracle_sql() -> str:
    """All pairs of query and candidate in DuckDB SQL, five nearest and every fiftieth query."""
    vector = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
    return f"""
WITH v AS (
  SELECT DISTINCT vec_id, {vector} AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, list_inner_product(e, e) AS own FROM v),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) / sqrt(a.own * b.own) AS score
  FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5"""
