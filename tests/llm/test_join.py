"""The Jaccard join against all pairs, its parts, and components."""

import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from curbflow.llm import ngram_join
from curbflow.llm.components import components

from .conftest import awkward_rows, prose


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows, percent=75):
    sets = {d: brute_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def joined(docs, **options):
    rows = ngram_join.jaccard_components(docs, **options).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in rows)


def expected(rows, **options):
    known = brute([(d, t) for d, t in rows if d is not None], **options)
    named = [(False, d, *known[d]) for d, _ in rows if d is not None]
    return sorted(named + [(True, 0, len(brute_set(t)), None) for d, t in rows if d is None])


def test_awkward_rows(awkward):
    assert joined(awkward) == expected([r[:2] for r in awkward_rows()])


def test_empty_table(nothing):
    assert joined(nothing) == []


@pytest.mark.parametrize("tile", [8, 1024])
def test_clusters_of_near_copies_and_shared_passages(spark, monkeypatch, tile):
    """Hot groups: edits around one text, copies, a passage most documents share, chains."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    chance = random.Random(5)
    base, passage = prose(1, 90).split(), prose(2, 40)
    rows = []
    for k in range(60):  # from nearly equal to beyond the threshold
        words = list(base)
        for at in chance.sample(range(90), chance.randint(0, 7)):
            words[at] = f"edit{k}"
        rows.append((1000 - k, " ".join(words)))
    rows += [(2000 + k, prose(50 + k, chance.randint(5, 30)) + " " + passage) for k in range(40)]
    rows += [(3000 + k, " ".join(prose(9, 400).split()[6 * k : 6 * k + 60])) for k in range(40)]
    rows += [(4000 + k, prose(77, 30)) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert joined(docs) == expected(rows)
    assert joined(docs, percent=40) == expected(rows, percent=40)


def test_most_typical_copy_without_id(spark):
    base = prose(1, 90).split()
    edited = [(k, " ".join([*base[: 7 * k], f"edit{k}", *base[7 * k + 1 :]])) for k in range(1, 13)]
    rows = [(None, " ".join(base)), *edited]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert expected(rows)[0][3] == expected(rows)[11][3] == 1
    assert joined(docs) == expected(rows)


@pytest.mark.parametrize("size", [1, 50, 1 << 18])
def test_frequent_shingles_of_a_batch(monkeypatch, size):
    monkeypatch.setattr(ngram_join, "RANGE", size)
    chance = np.random.default_rng(3)
    pool = chance.integers(0, 2**64, 150, dtype=np.uint64)
    pool[:2] = 0, 2**64 - 1
    sets = [np.unique(chance.choice(pool, n)) for n in (0, 1, 1, 5, 20, 40, 80, 80, 120, 200, 200, 200) * 2]
    names = chance.permutation(len(sets))
    copies = Counter(s for held in sets for s in held.tolist())
    often = {s: n for s, n in copies.items() if n >= ngram_join.REPORTED}
    share = [sum(s in often for s in held.tolist()) / max(1, len(held)) for held in sets]
    found = list(zip(*[column.tolist() for column in ngram_join._often(sets, names)]))
    assert 0 < len(often) < len(copies) and [row[0] for row in found] == sorted(often)
    for s, n, name, part in found:
        best = min((-share[k], names[k]) for k, held in enumerate(sets) if s in held)
        assert n == often[s] and (-part, name) == best
    assert all(not len(column) for column in ngram_join._often([], names[:0]))


def test_memory_for_frequent_shingles_of_a_batch():
    """What is made beside the sets stays below their size."""
    chance = np.random.default_rng(4)
    pool = chance.integers(0, 2**64, 400_000, dtype=np.uint64)
    sets = [np.unique(chance.choice(pool, 400)) for _ in range(5000)]
    tracemalloc.start()
    try:
        shingle = ngram_join._often(sets, np.arange(len(sets)))[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # A place of a frequent hash takes four bytes; one range of hashes is sorted at a time.
    assert len(shingle) > 50_000 and peak < sum(s.nbytes for s in sets)


def test_random_small_sets(spark):
    chance = random.Random(8)
    rows = [(k, " ".join(chance.choices("abc", k=chance.randint(0, 12)))) for k in range(150)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_bitmap_bound_never_rejects_a_link():
    chance = random.Random(2)
    for _ in range(2000):
        n = chance.randint(1, 120)
        a = np.unique(np.array([chance.getrandbits(64) for _ in range(n)], np.uint64))
        keep = a[[chance.random() < 0.9 for _ in a]]
        more = np.array([chance.getrandbits(64) for _ in range(chance.randint(0, 20))], np.uint64)
        b = np.unique(np.concatenate([keep, more]))
        if len(b) and ngram_join.linked(a, b, 75):
            assert ngram_join.may_link(
                len(a), ngram_join.parity_bitmap(a), len(b), ngram_join.parity_bitmap(b), 75
            )


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 201), (201, 202), (202, 200)]
    random.Random(1).shuffle(links)
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
