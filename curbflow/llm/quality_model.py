"""Quality classifier: averaged vectors of hashed words and character n-grams, softmax output.

Training runs in numpy on a bounded sample of labelled documents. The model is linear
in the averaged features, so scoring needs one number per bucket: the difference of the
two classes' outputs. It is shipped to the tasks, whose size depends on the number of
buckets only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, texts_of

BUCKET_BITS = 16
LENGTHS = (3, 4, 5)
DIMENSIONS = 8
# Labelled documents used for training, at most; the lowest in the order of a hash.
SAMPLE_DOCS = 4000
# Text whose features a worker holds at a time; they take many times as much.
SCORED_BYTES = 256 << 10
EPOCHS = 12
RATE = 2.0
SEED = 7

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for word hashes from running sums."""
    size = 1 << max(10, (n - 1).bit_length())

    def make():
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, np.uint64(base & _MASK))
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        return tuple(both)

    return kept(f"powers:{size}", make)


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: list[str], bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and buckets of the features of joined texts, one kind of feature at a time.

    Text k owns the places from its leading separator to the last character. Words and
    character n-grams count; an n-gram may begin or end with the blank beside a word.
    """
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    space = np.isin(points, _SPACES)
    codes = np.where(space, 32, points).astype(np.uint64)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers(len(codes) + 1)
    running = np.append(np.uint64(0), np.cumsum(codes * up[: len(codes)], dtype=np.uint64))
    yield starts, _buckets((running[ends] - running[starts]) * down[starts] + np.uint64(1), bits)
    inside = ~space
    for n in LENGTHS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        whole = np.ones(count, bool)
        hashes = np.full(count, np.uint64(n))
        for k in range(n):
            hashes = hashes * np.uint64(_BASE) + codes[k : k + count]
            if 0 < k < n - 1:
                whole &= inside[k : k + count]
        places = np.flatnonzero(whole)
        yield places, _buckets(hashes[places], bits)


@dataclass
class Model:
    """What one feature adds to the log-odds of label 1 before averaging, and the prior's."""

    weight: np.ndarray
    bias: float
    bits: int = BUCKET_BITS

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        bounds = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        total = np.zeros(bounds[-1] + 1)
        count = np.zeros(bounds[-1] + 1)
        for places, buckets in features(texts, self.bits):
            total[places] += self.weight[buckets]
            count[places] += 1
        sums, counts = np.add.reduceat(total, bounds[:-1]), np.add.reduceat(count, bounds[:-1])
        return 1 / (1 + np.exp(-(sums / np.maximum(counts, 1) + self.bias)))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BUCKET_BITS) -> Model:
    """Stochastic gradient descent over documents: bucket numbers, shares of features, label."""
    chance = np.random.default_rng(SEED)
    vectors = chance.uniform(-1, 1, (1 << bits, DIMENSIONS)) / DIMENSIONS
    output = np.zeros((DIMENSIONS + 1, 2))
    steps, done = EPOCHS * max(1, len(samples)), 0
    for _ in range(EPOCHS):
        for k in chance.permutation(len(samples)):
            buckets, share, label = samples[k]
            share = share.astype(float)
            rate = RATE * (1 - done / steps)
            hidden = np.append(share @ vectors[buckets], 1.0)
            raw = hidden @ output
            error = np.exp(raw - raw.max())
            error /= error.sum()
            error[label] -= 1
            back = output[:-1] @ error
            output -= rate * 0.1 * np.outer(hidden, error)
            vectors[buckets] -= rate * share[:, None] * back * len(share) ** 0.5
            done += 1
    gap = output[:, 1] - output[:, 0]
    return Model(vectors @ gap[:-1], float(gap[-1]), bits)


def fit(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """A model of ``labels.quality`` from at most ``sample_docs`` documents of the learning fold.

    Only rows whose id is not held out count. A document labelled twice takes its lower
    label. Features of the sample are made by the tasks; the driver receives one row of
    bucket shares per sampled document. Equal rows under one id count once, and where an
    id stands for several texts, so that more than ``sample_docs`` rows match, those of
    lowest hash of id and features are taken.
    """
    order = F.xxhash64("_id", F.lit(SEED))
    chosen = (
        labels.select(F.col(id_col).alias("_id"), "quality").where("_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("quality").alias("_quality"))
        .orderBy(order, "_id").limit(sample_docs)
    )
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    sampled = rows.join(F.broadcast(chosen), rows["_doc"] == chosen["_id"]).select("_text", "_quality", "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SCORED_BYTES):
                found, sizes = [], []
                for text in texts_of(part.column(0)):
                    every = np.concatenate([b for _, b in features([text])])
                    buckets, copies = np.unique(every, return_counts=True)
                    found.append(buckets.astype(np.int32))
                    sizes.append((copies / max(1, len(every))).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2).cast(pa.string()), part.column(1).cast(pa.int32()),
                        pa.array(found, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.float32())),
                    ],
                    names=["id", "label", "buckets", "share"],
                )

    features_of = sampled.mapInArrow(run, "id string, label int, buckets array<int>, share array<float>")
    # Grouped by digests: copies meet as one row, on the way and after it.
    numbered = features_of.withColumn("digest", F.xxhash64("buckets", "share")).groupBy("id", "label", "digest").agg(
        F.any_value("buckets").alias("buckets"), F.any_value("share").alias("share")
    )
    table = numbered.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "label", "digest").limit(sample_docs).toArrow()
    samples = [
        (
            table["buckets"][i].values.to_numpy(), table["share"][i].values.to_numpy(),
            int(table["label"][i].as_py() == 1), table["id"][i].as_py(),
        )
        for i in range(table.num_rows)
    ]
    # Arrays stay views of the one table received; ties are told apart by a short digest.
    samples.sort(key=lambda s: (s[3], s[2], hashlib.blake2b(s[0], digest_size=16).digest()))
    return train([s[:3] for s in samples])


def held_out(number: Column) -> Column:
    """True for ids whose CRC-32 as text is divisible by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(number.cast("string"), F.lit(""))) % 5 == 0


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row; null and empty texts get the prior's."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.bits))

    def run(texts: pa.Array) -> pa.Array:
        weight, bias, bits = shipped.value
        own = Model(weight, bias, bits)
        block = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [own.scores(texts_of(p.column(0))) for p in slices(block, 0, SCORED_BYTES)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col(text_col)))


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_docs: int = SAMPLE_DOCS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    Every whole text is scored, repeated rows each; scores depend on the text alone.
    Without any usable label all scores are 0.5. Columns of ``docs`` with one of the three
    names are replaced in place, unless the column is the id or the text, which is refused.
    """
    taken = {"held_out", "score", "predicted"} & {id_col.lower(), text_col.lower()}
    if taken:
        raise ValueError(f"id and text may not be named {sorted(taken)}")
    model = fit(docs, labels, sample_docs, id_col, text_col)
    scored = with_score(docs.withColumn("held_out", held_out(F.col(id_col))), model, text_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
