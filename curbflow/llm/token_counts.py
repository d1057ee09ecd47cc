"""Token counts of documents from pre-token frequencies, without making any ids.

Each document becomes the frequencies of its pre-tokens. A block of documents lays them
out as postings, cut into buckets of pre-tokens. Buckets are what is shuffled: in its
bucket every distinct pre-token meets its frequencies, its pieces are counted there
once, and the products are summed per document.

Pre-tokens that many documents of a block share do not travel: a worker counts the pieces
of each once, remembers them, and multiplies on the spot. So a bucket gets few postings
of one pre-token from a block, and buckets are kept apart by groups of splits, which
bounds what meets in one task however large the table is.
"""

from __future__ import annotations

import json
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PairIndex
from .common import kept, shipped, slices, texts_of

BATCH_BYTES = 24 << 20
# Bytes of text for each bucket of pre-tokens.
BUCKET_BYTES = 16 << 20
# Buckets of one group of splits; a larger table has more groups, each with buckets of its own.
GROUP_BUCKETS = 4096
# Documents of a block that must share a pre-token for it to be counted where it is.
SHARED_DOCS = 64
# Shared pre-tokens a worker remembers before it starts afresh.
REMEMBERED = 200_000
# Products a task holds before it sums them.
HELD_PRODUCTS = 2_000_000

# Runs of plain text a byte-level splitter never joins: a word with one blank before
# it, or white space up to the last one before a word.
CHUNK = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
# Code points, first and last, whose standing as white space is left to the library.
ODD_RANGES = (
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F),
    (0x2028, 0x202F), (0x205F, 0x2064), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
)
ODD = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ODD_RANGES) + "]")


class PreTokens:
    """Splits texts into numbered pre-tokens of a byte-level tokenizer file."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        if parsed["pre_tokenizer"]["type"] != "ByteLevel" or parsed.get("normalizer"):
            raise ValueError("not a plain byte-level tokenizer")
        self.splitter = Tokenizer.from_str(spec.decode()).pre_tokenizer
        added = sorted((t["content"] for t in parsed.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.reset()

    def reset(self) -> None:
        """Forget all numbers; called per batch, so what is held stays bounded by one."""
        self.number: dict[str, int] = {}
        self.chunk: dict[str, bytes] = {}

    def _code(self, tokens: list[str]) -> bytes:
        return np.array([self.number.setdefault(t, len(self.number)) for t in tokens], "<i4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.chunk]
        for c in new:
            if c.isspace():
                self.chunk[c] = self._code([t for t, _ in self.splitter.pre_tokenize_str(c)])
        new = [c for c in new if not c.isspace()]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            # A lone line break between words is a pre-token of its own.
            tokens = self.splitter.pre_tokenize_str("\n".join(part))
            ends = np.cumsum([len(c) + 1 for c in part])
            owner = np.searchsorted(ends, [span[0] for _, span in tokens], side="right").tolist()
            found: list[list[str]] = [[] for _ in part]
            for (token, (start, _)), k in zip(tokens, owner):
                if start < ends[k] - 1:
                    found[k].append(token)
            for chunk, own in zip(part, found):
                self.chunk[chunk] = self._code(own)

    def split(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """Numbers of each text's pre-tokens as int32 bytes, and its special tokens."""
        plain: list[list] = []
        specials = []
        needed: set[str] = set()
        for text in texts:
            parts = self.special.split(text) if self.special and self.special.search(text) else [text]
            specials.append(len(parts) - 1)
            own: list = []
            for part in parts:
                if ODD.search(part):
                    own.append(self._code([t for t, _ in self.splitter.pre_tokenize_str(part)]))
                else:
                    chunks = CHUNK.findall(part)
                    needed.update(chunks)
                    own.append(chunks)
            plain.append(own)
        self._learn(needed)
        known = self.chunk.__getitem__
        return [
            b"".join(x for o in own for x in ([o] if isinstance(o, bytes) else map(known, o))) for own in plain
        ], specials


_KINDS = "bucket int, block long, posting binary, ids array<{kind}>, bytes array<long>, base array<long>"
_NAMES = ["bucket", "block", "posting", "ids", "bytes", "base"]


class SharedPieces:
    """Piece counts of the pre-tokens that blocks share, counted once per worker."""

    def __init__(self, spec: bytes):
        self.index = PairIndex(json.loads(spec)["model"])
        self.pieces: dict[str, int] = {}

    def counts(self, words: list[str]) -> np.ndarray:
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        new = [w for w in words if w not in self.pieces]
        if new:
            self.pieces.update(zip(new, self.index.encode(new)[1].tolist()))
        return np.array([self.pieces[w] for w in words], np.int64)


def _postings(
    parts: list[np.ndarray], vocabulary: list[str], first_bucket: int, buckets: int, shared_docs: int, shared: SharedPieces
) -> tuple[np.ndarray, Iterator[tuple[int, bytes]]]:
    """Tokens per document of the shared pre-tokens of a block, and its other postings per bucket.

    Postings are pre-tokens, how many documents have each, which, and how often.
    """
    bucket = np.fromiter((zlib.crc32(t.encode()) % buckets for t in vocabulary), np.int64, len(vocabulary))
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    docs = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    tokens = rank[np.concatenate(parts)] if parts else np.empty(0, np.int64)
    pairs, freq = np.unique((tokens << 32) | docs, return_counts=True)
    sizes = np.bincount(pairs >> 32, minlength=len(order))

    many = sizes >= shared_docs
    pieces = np.zeros(len(order), np.int64)
    pieces[many] = shared.counts([vocabulary[k] for k in order[many].tolist()])
    here = many[pairs >> 32]
    done = np.bincount(
        pairs[here] & 0xFFFFFFFF, weights=pieces[pairs[here] >> 32] * freq[here], minlength=len(parts)
    ).astype(np.int64)
    pairs, freq = pairs[~here], freq[~here]
    order, sizes = order[~many], sizes[~many]

    def rest() -> Iterator[tuple[int, bytes]]:
        ends = np.append(0, np.cumsum(sizes))
        doc = (pairs & 0xFFFFFFFF).astype(np.uint16 if len(parts) <= 1 << 16 else np.uint32)
        small = freq.astype(np.min_scalar_type(freq.max(initial=0)))
        own = bucket[order]
        for number in np.unique(own).tolist():
            first, last = np.searchsorted(own, [number, number + 1])
            held = slice(ends[first], ends[last])
            words = "\n".join([vocabulary[k] for k in order[first:last].tolist()])
            yield first_bucket + number, pickle.dumps((words, sizes[first:last].astype(np.uint32), doc[held], small[held]))

    return done, rest()


def _sparse(doc: np.ndarray, value: np.ndarray) -> bytes:
    """Sums of the documents of a block that have any; gaps between documents compress well."""
    return pickle.dumps((np.diff(doc, prepend=0).astype(np.int32), value.astype(np.min_scalar_type(value.max()))))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text.

    One row per row of ``docs``: repeated rows stay repeated, a null id stays null, a
    null text counts as empty (0 bytes, 0 tokens). Special tokens written in a text
    count one each. Other columns are not read. Documents are known by block and place
    in the block, both fixed by the split they are read from, so a task that runs again
    makes the same rows. The number of buckets follows the bytes of text, so a bucket
    has about the same size for every input. A pre-token has at most ``SHARED_DOCS``
    postings from a block, and meets those of one group of splits in a task; its pieces are
    counted once in each.
    """
    spec = shipped(docs.sparkSession, tokenizer)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    groups = -(-buckets // GROUP_BUCKETS)
    of_group = -(-buckets // groups)
    shared_docs = SHARED_DOCS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = kept(f"pre-tokens:{tokenizer}", lambda: PreTokens(spec.value))
        shared = kept(f"shared-pieces:{tokenizer}", lambda: SharedPieces(spec.value))
        split_number = TaskContext.get().partitionId()
        block, first_bucket = split_number << 32, split_number % groups * of_group
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                splitter.reset()
                parts, base, sizes = [], [], []
                for piece in slices(part, 1):
                    texts = texts_of(piece.column(1))
                    raw, specials = splitter.split(texts)
                    parts += [np.frombuffer(r, "<i4") for r in raw]
                    base += specials
                    sizes += [len(t.encode()) for t in texts]
                longs = pa.list_(pa.int64())
                done, postings = _postings(parts, list(splitter.number), first_bucket, of_group, shared_docs, shared)
                base = (np.array(base, np.int64) + done).tolist()
                for bucket, posting in postings:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([posting], pa.binary()),
                            pa.nulls(1, pa.list_(part.column(0).type)), pa.nulls(1, longs), pa.nulls(1, longs),
                        ],
                        names=_NAMES,
                    )
                every = pa.array(np.array([0, len(parts)], np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block % buckets], pa.int32()), pa.array([block], pa.int64()), pa.nulls(1, pa.binary()),
                        pa.ListArray.from_arrays(every, pa.concat_arrays([part.column(0)])),
                        pa.array([sizes], longs), pa.array([base], longs),
                    ],
                    names=_NAMES,
                )
                block += 1

    blocks = rows.mapInArrow(split, _KINDS.format(kind=kind))
    # A partition per bucket: dealt by a hash, some would get several and some none.
    dealt = blocks.repartitionById(groups * of_group, "bucket").sortWithinPartitions("bucket")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept(f"pair-index:{tokenizer}", lambda: PairIndex(json.loads(spec.value)["model"]))
        products: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting: list[tuple[int, bytes]] = []
        current = None

        def multiply() -> None:
            """Count the pieces of a bucket's distinct pre-tokens, each once, and weight them."""
            opened = [(block, *pickle.loads(posting)) for block, posting in waiting]
            waiting.clear()
            number: dict[str, int] = {}
            places = [
                np.array([number.setdefault(w, len(number)) for w in words.split("\n")]) for _, words, *_ in opened
            ]
            pieces = index.encode(list(number))[1] if number else np.empty(0, np.int64)
            for (block, _, sizes, doc, freq), place in zip(opened, places):
                value = np.repeat(pieces[place], sizes) * freq
                products.append((np.full(len(doc), block), doc.astype(np.int64), value))

        def summed() -> Iterator[pa.RecordBatch]:
            block, doc, value = (np.concatenate(x) for x in zip(*products))
            products.clear()
            for number in np.unique(block).tolist():
                own = block == number
                total = np.bincount(doc[own], weights=value[own]).astype(np.int64)
                some = np.flatnonzero(total)
                if len(some):
                    longs = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([current], pa.int32()), pa.array([number], pa.int64()),
                            pa.array([_sparse(some, total[some])], pa.binary()), pa.nulls(1, ids_type),
                            pa.nulls(1, longs), pa.nulls(1, longs),
                        ],
                        names=_NAMES,
                    )

        ids_type = None
        for batch in batches:
            ids_type = batch.schema.field("ids").type
            whole = batch.column(2).is_null()
            if whole.true_count:
                yield batch.filter(whole)
            for bucket, block, posting in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if posting is None:
                    continue
                if bucket != current and waiting:
                    multiply()
                    if sum(len(p[1]) for p in products) >= HELD_PRODUCTS:
                        yield from summed()
                current = bucket
                waiting.append((block, posting))
        if waiting:
            multiply()
        if products:
            yield from summed()

    def finish(key, group):
        at = group["ids"].is_valid().to_pylist().index(True)
        ids = group["ids"].combine_chunks()[at].values
        total = np.array(group["base"][at].as_py(), np.int64)
        for posting in group["posting"].to_pylist():
            if posting is not None:
                gaps, value = pickle.loads(posting)
                total[np.cumsum(gaps)] += value
        return pa.table([ids, group["bytes"].combine_chunks()[at].values, pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    sums = dealt.mapInArrow(count, _KINDS.format(kind=kind))
    return sums.groupBy("block").applyInArrow(finish, f"doc_id {kind}, n_bytes long, n_tokens long")
