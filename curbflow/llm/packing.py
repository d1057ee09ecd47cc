"""Packing of tokenised documents into sequences, first-fit decreasing per random group.

Documents are cut into full pieces and one rest. Pieces are dealt to random groups
of bounded size, and each group is packed on its own: longest piece first, each into
the first sequence with room, found by a tournament tree of the room that is left.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, shipped, slices, texts_of

# Pieces of a group on average: enough of every size for full sequences.
GROUP_PIECES = 4096
# Copies of a piece that one step lays out.
RUN = 1 << 16
# White-space runs longer than this are left to the reference library.
LONG_RUN = re.compile(r"\s{2000}")


def byte_of_symbol() -> dict[str, int]:
    """Bytes behind the printable symbols of a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Ids of a byte-level BPE file, as the tokenizers library gives them.

    The ranks run in the same order as the ids, so a rank-driven encoder yields the
    same ids faster; texts it might read otherwise go to the library itself.
    """

    def __init__(self, spec: bytes):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self.library = Tokenizer.from_str(spec.decode())
        self.added = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        vocab, back = parsed["model"]["vocab"], byte_of_symbol()
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in parsed["model"]["merges"]]
        splitter = parsed["pre_tokenizer"]
        if merged != sorted(merged) or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"]:
            raise ValueError("not a byte-level vocabulary in merge order")
        ranks = {
            bytes(back[c] for c in token): number for token, number in vocab.items() if token not in self.added
        }
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def ids(self, text: str) -> array:
        if len(text) > 2000 and LONG_RUN.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids)
        if self.special is None or not self.special.search(text):
            return array("I", self.fast.encode_ordinary(text))
        found = array("I")
        for k, part in enumerate(self.special.split(text)):
            found.extend([self.added[part]] if k % 2 else self.fast.encode_ordinary(part))
        return found


class RoomTree:
    """Tournament tree over sequences: every node holds the larger room of its two children."""

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """The first sequence with ``size`` left, and the room it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] = had - size
        found = at - self.leaves
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return found, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece; ``sizes`` must not increase."""
    tree = RoomTree(len(sizes), capacity)
    taken = [tree.take(size) for size in sizes]
    return [at for at, _ in taken], [capacity - had for _, had in taken]


def cut(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: all full but the last of a document."""
    spec = shipped(docs.sparkSession, tokenizer)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(f"byte:{tokenizer}", lambda: ByteLevel(spec.value))
        for batch in batches:
            for block in slices(batch, 1):
                place, start, length, crc, total = [], [], [], [], []
                for row, text in enumerate(texts_of(block.column(1))):
                    ids = codec.ids(text)
                    ids.append(end_id)
                    raw, n = memoryview(ids.tobytes()), len(ids)
                    for at in range(0, n, capacity):
                        size = min(capacity, n - at)
                        place.append(row)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column(0).take(pa.array(place, pa.int64())),
                        *[pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with a number ``copy`` among equal ones, from their counts alone.

    Equal pieces are counted before and after a shuffle and laid out again in two steps,
    so that no array grows with their number.
    """
    counted = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("copies"))
    last = F.col("copies") - 1
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(RUN).cast("long"))))
    return runs.withColumn("copy", F.explode(F.sequence("run", F.least(F.col("run") + (RUN - 1), last)))).drop(
        "copies", "run"
    )


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, seed: int = 17,
    group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Where every token of every document goes: one row per piece.

    Returns ``doc_id``, ``start`` and ``length`` of the piece in its document's ids,
    ``ids_crc32`` of its ids, ``doc_tokens`` (the closing ``end_id`` included),
    ``sequence_id`` and ``offset`` in that sequence. Sequences are filled without gaps
    from 0. A null text counts as empty (one piece, the closing id alone); null and
    repeated ids are packed like others, each row for itself; other columns are not
    read. The number of groups follows the rows and bytes of the input, so a group has
    about ``group_pieces`` pieces at every size; dealing by a hash of id, position,
    content and a number within equal pieces spreads long documents and repeated rows
    alike and repeats the same deal when a task is lost.
    """
    counted = docs.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")
    ).first()
    groups = max(1, -(-(counted.n + counted.b // capacity) // group_pieces))
    pieces = cut(docs, tokenizer, capacity, end_id, id_col, text_col)
    dealt = _numbered(pieces).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy", F.lit(seed)), F.lit(groups))
    ).drop("copy")

    def run(key, group):
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        group = group.sort_by(order)
        sequence, offset = first_fit_decreasing(group["length"].to_pylist(), capacity)
        number = (key[0].as_py() << 32) + np.array(sequence, np.int64)
        return (
            group.drop_columns(["group"])
            .append_column("sequence_id", pa.array(number))
            .append_column("offset", pa.array(offset, pa.int64()))
        )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("group").applyInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
