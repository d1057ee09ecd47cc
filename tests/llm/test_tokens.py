"""BPE, packing and token counts against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from curbflow.llm import bpe, packing, token_counts
from curbflow.llm.queries import BYTE_BPE, WORD_BPE

from .conftest import awkward_rows


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTE_BPE)


def strange_texts(n: int) -> list[str]:
    chance = random.Random(3)
    alphabet = "ab eé\n\t'sS.,!0１日🎉́\x1c\x85\xa0 ​Σİß" + " " * 6
    return ["".join(chance.choices(alphabet, k=chance.randint(0, 60))) for _ in range(n)]


def expected(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode_as_the_library(spark, awkward, word_tokenizer):
    found = bpe.encode_decode(awkward, WORD_BPE).collect()
    assert sorted(map(str, [(r.doc_id, list(r.ids), r.decoded) for r in found])) == sorted(
        map(str, [
            (row[0], ids, word_tokenizer.decode(ids, skip_special_tokens=False))
            for row in awkward_rows() for ids in [expected(word_tokenizer, row[1])]
        ])
    )


def test_encode_strange_texts(spark, word_tokenizer):
    texts = strange_texts(400)
    found = bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD_BPE)
    for row in found.collect():
        ids = expected(word_tokenizer, texts[row.doc_id])
        assert list(row.ids) == ids and row.decoded == word_tokenizer.decode(ids, skip_special_tokens=False)


def test_pair_index_takes_equal_symbols_in_pairs():
    vocab = {"a": 0, "b": 1, "aa": 2, "aaaa": 3, "ab": 4}
    index = bpe.PairIndex({"vocab": vocab, "merges": [["a", "a"], ["aa", "aa"], ["a", "b"]]})
    ids, sizes = index.encode(["aaaaa", "", "aab", "ab", "aaaaaaab"])
    assert ids.tolist() == [3, 0, 2, 1, 4, 3, 2, 4]
    assert sizes.tolist() == [2, 0, 2, 1, 3]


def test_empty_table(nothing):
    assert bpe.encode_decode(nothing, WORD_BPE).count() == 0
    assert packing.pack(nothing, BYTE_BPE).count() == 0
    assert token_counts.count_tokens(nothing, BYTE_BPE).count() == 0


def test_token_counts_as_the_library(awkward, byte_tokenizer):
    found = token_counts.count_tokens(awkward, BYTE_BPE).collect()
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in found])) == sorted(
        map(str, [(row[0], len((row[1] or "").encode()), len(expected(byte_tokenizer, row[1]))) for row in awkward_rows()])
    )


def test_token_counts_of_strange_texts(spark, byte_tokenizer):
    texts = strange_texts(400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for row in token_counts.count_tokens(docs, BYTE_BPE).collect():
        assert row.n_tokens == len(expected(byte_tokenizer, texts[row.doc_id])), texts[row.doc_id]


@pytest.mark.parametrize("capacity", [8, 1024])
def test_packing_holds_every_token_once(awkward, byte_tokenizer, capacity):
    rows = packing.pack(awkward, BYTE_BPE, capacity=capacity, group_pieces=16).collect()
    wanted = [(row[0], expected(byte_tokenizer, row[1]) + [0]) for row in awkward_rows()]
    pieces = sorted(
        (str(d), at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes()), len(ids))
        for d, ids in wanted for at in range(0, len(ids), capacity)
    )
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == pieces
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= capacity


def test_packing_of_strange_texts(spark, byte_tokenizer):
    texts = strange_texts(400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack(docs, BYTE_BPE).collect():
        ids = expected(byte_tokenizer, texts[r.doc_id]) + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_first_fit_decreasing_as_by_hand():
    sizes = sorted(random.Random(1).choices(range(1, 101), k=300), reverse=True)
    room, wanted = [], []
    for size in sizes:
        at = next((k for k, r in enumerate(room) if r >= size), len(room))
        if at == len(room):
            room.append(100)
        wanted.append((at, 100 - room[at]))
        room[at] -= size
    assert list(zip(*packing.first_fit_decreasing(sizes, 100))) == wanted


@pytest.mark.parametrize("shared_docs", [1, 3, 10**9])
def test_token_counts_in_many_buckets_and_groups(spark, monkeypatch, byte_tokenizer, shared_docs):
    """Pre-tokens counted where they are, in buckets, or some here and some there, all give the library's sums."""
    for name, value in (("BUCKET_BYTES", 500), ("GROUP_BUCKETS", 4), ("SHARED_DOCS", shared_docs), ("BATCH_BYTES", 2000)):
        monkeypatch.setattr(token_counts, name, value)
    texts = strange_texts(200) + [" the same old words again"] * 100 + ["", "\n\n", " the"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, BYTE_BPE).collect()}
    assert found == {k: len(expected(byte_tokenizer, t)) for k, t in enumerate(texts)}


def test_repeated_rows_are_dealt_to_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 7)
    docs = spark.range(3000).selectExpr("CAST(IF(id % 2 = 0, 5, NULL) AS LONG) AS doc_id", "'the same words' AS text")
    rows = packing.pack(docs, BYTE_BPE, capacity=64, group_pieces=100).collect()
    assert len(rows) == 3000 and sum(r.doc_id is None for r in rows) == 1500
    groups = {}
    for r in rows:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(groups) >= 30 and max(groups.values()) < 300
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000
