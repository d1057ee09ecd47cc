"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a partition's batch are laid out as one linked list of
symbols. An index maps every adjacent pair that some merge joins to all its
positions. Merges are applied in ascending rank, each at all positions at once,
and only the lists of the pairs beside a merged position change.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, shipped, slices, texts_of

# Bytes of chunk text a worker remembers before it starts afresh.
MEMORY_BYTES = 8 << 20
BATCH_BYTES = 24 << 20

OTHER_SPACE = re.compile(r"[^\S ]")


class PairIndex:
    """Merges of a BPE vocabulary, applied to many words at once."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        width = 1 + max([ord(t[0]) for t in vocab if len(t.removesuffix(suffix)) == 1 or len(t) == 1] + [0])
        self.first = np.full(width, -3, np.int64)
        self.last = np.full(width, -3, np.int64)
        for token, number in vocab.items():
            if len(token) == 1:
                self.first[ord(token)] = number
                if not suffix:
                    self.last[ord(token)] = number
            elif suffix and token.endswith(suffix) and len(token) == len(suffix) + 1:
                self.last[ord(token[0])] = number
        self.span = 1 + max(vocab.values())
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left * self.span + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge joins it."""
        wanted = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(hit, self.by_key[at], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many belong to each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(points)
        if not n:
            return np.empty(0, np.int64), sizes
        ends = np.cumsum(sizes)
        filled = sizes > 0
        symbol = np.append(self.first[points], -1)
        symbol[ends[filled] - 1] = self.last[points[ends[filled] - 1]]
        if (symbol[:n] < 0).any():
            raise ValueError("a symbol of the text is not in the vocabulary")
        after = np.arange(1, n + 2)
        after[ends[filled] - 1] = n
        before = np.arange(-1, n)
        before[(ends - sizes)[filled]] = n

        occurrences: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(places: np.ndarray) -> None:
            ranks = self._ranks(symbol[places], symbol[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts)):
                if rank not in occurrences:
                    occurrences[rank] = []
                    heapq.heappush(active, rank)
                occurrences[rank].append(part)

        enlist(np.flatnonzero(after[:n] < n))
        while active:
            rank = heapq.heappop(active)
            lists = occurrences.pop(rank)
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            a, b = self.left[rank], self.right[rank]
            nexts = after[places]
            live = (symbol[places] == a) & (symbol[nexts] == b)
            places, nexts = places[live], nexts[live]
            if not len(places):
                continue
            if a == b:  # in a run of equal symbols every second pair is free
                start = np.append(True, nexts[:-1] != places[1:])
                run = np.maximum.accumulate(np.where(start, np.arange(len(places)), 0))
                free = (np.arange(len(places)) - run) % 2 == 0
                places, nexts = places[free], nexts[free]
            symbol[places] = self.made[rank]
            symbol[nexts] = -2
            beyond = after[nexts]
            after[places] = beyond
            before[beyond] = places
            ahead = before[places]
            enlist(np.unique(np.concatenate([ahead[ahead < n], places[beyond < n]])))
        alive = symbol[:n] >= 0
        counts = np.bincount(np.repeat(np.arange(len(words)), sizes)[alive], minlength=len(words))
        return symbol[:n][alive], counts


class Codec:
    """Encoder and decoder of a tokenizer file, with a bounded memory of chunks.

    White space ends every pre-token of a split-and-drop tokenizer, so a chunk
    between white space has the same ids wherever it stands. Normalising and
    splitting a new chunk is left to the tokenizer's own parts.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        parts = Tokenizer.from_str(spec.decode())
        self.normalizer, self.splitter = parts.normalizer, parts.pre_tokenizer
        self.index = PairIndex(parsed["model"])
        vocab = parsed["model"]["vocab"]
        added = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        self.names = [""] * (1 + max([*vocab.values(), *added.values()]))
        for token, number in {**vocab, **added}.items():
            self.names[number] = token
        self.added = {k: np.array([v], "<i4").tobytes() for k, v in added.items()}
        longest_first = sorted(added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if added else None
        self.memory: dict[str, bytes] = {"": b""}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        """Alternately the text between special tokens and a special token."""
        if self.special is None or not self.special.search(text):
            return [text]
        found, at = [], 0
        for hit in self.special.finditer(text):
            found += [text[at : hit.start()], hit.group()]
            at = hit.end()
        return [*found, text[at:]]

    @staticmethod
    def chunks(text: str) -> list[str]:
        for space in "\n\t\r\x0b\x0c":
            if space in text:
                text = text.replace(space, " ")
        return text.split(" ")

    def _pre_tokens(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of all chunks in a row, and how many belong to each."""
        joined = " ".join(chunks)
        if len(chunks) > 1 and OTHER_SPACE.search(joined):  # one chunk may become several, or none
            half = len(chunks) // 2
            (a, m), (b, n) = self._pre_tokens(chunks[:half]), self._pre_tokens(chunks[half:])
            return a + b, np.append(m, n)
        clean = self.normalizer.normalize_str(joined) if self.normalizer else joined
        if len(chunks) == 1:
            found = [t for t, _ in self.splitter.pre_tokenize_str(clean)]
            return found, np.array([len(found)])
        sizes = [len(c) for c in clean.split(" ")]
        tokens = self.splitter.pre_tokenize_str(clean)
        ends = np.cumsum(np.array(sizes) + 1)
        starts = np.fromiter((span[0] for _, span in tokens), np.int64, len(tokens))
        owner = np.searchsorted(ends, starts, side="right")
        return [t for t, _ in tokens], np.bincount(owner, minlength=len(chunks))

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks not remembered, all pre-tokens of them in one index."""
        if self.held > MEMORY_BYTES:
            self.memory, self.held = {"": b""}, 0
        new = [c for c in chunks if c not in self.memory]
        self.held += sum(map(len, new))
        owners: list[int] = []
        counts: list[int] = []
        words: dict[str, int] = {}
        for at in range(0, len(new), 20_000):
            tokens, sizes = self._pre_tokens(new[at : at + 20_000])
            owners += [words.setdefault(t, len(words)) for t in tokens]
            counts += sizes.tolist()
        ids, sizes = self.index.encode(list(words))
        raw, ends = ids.astype("<i4").tobytes(), np.cumsum(sizes) * 4
        cut = [raw[e - 4 * s : e] for e, s in zip(ends.tolist(), sizes.tolist())]
        at = 0
        for chunk, count in zip(new, counts):
            if count == 1:
                self.memory[chunk] = cut[owners[at]]
            else:
                self.memory[chunk] = b"".join([cut[k] for k in owners[at : at + count]])
            at += count

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Its chunks must have been learnt."""
        found = []
        for text in texts:
            raw = []
            for k, piece in enumerate(self.pieces(text)):
                raw += [self.added[piece]] if k % 2 else map(self.memory.__getitem__, self.chunks(piece))
            found.append(np.frombuffer(b"".join(raw), "<i4"))
        return found

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined by a space: what a tokenizer without a decoder does, specials kept."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))

    def distinct_chunks(self, texts: list[str]) -> set[str]:
        found: set[str] = set()
        for text in texts:
            for piece in self.pieces(text)[::2]:
                found.update(self.chunks(piece))
        return found


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text and the text they decode to.

    Returns ``doc_id`` (of the id column's type), ``ids`` array<int> and ``decoded``
    string, one row per row of ``docs``; other columns are not read. A null text
    counts as empty: no ids, empty decoded text. Repeated rows stay repeated and a
    null id is kept. Special tokens written in a text get their own id. The
    tokenizer must drop white space between pre-tokens and join pieces by a space
    when it decodes. A narrow step: rows do not move, memory is bounded by an
    Arrow batch and the chunk memory, and a lost task reads its split again.
    """
    spec = shipped(docs.sparkSession, tokenizer)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(f"codec:{tokenizer}", lambda: Codec(spec.value))
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                chunks: set[str] = set()
                for block in slices(part, 1):
                    chunks |= codec.distinct_chunks(texts_of(block.column(1)))
                codec.learn(chunks)
                for block in slices(part, 1):
                    ids = codec.encode_block(texts_of(block.column(1)))
                    offsets = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
                    values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            block.column(0),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
                            pa.array([codec.decode(i) for i in ids], pa.string()),
                        ],
                        names=["doc_id", "ids", "decoded"],
                    )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
