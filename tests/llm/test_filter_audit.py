"""The audit against a document-by-document simulation of all orders."""

from collections import Counter
from itertools import permutations

import pytest

from curbflow.llm import filter_audit

from .conftest import SCHEMA, EXTRAS, awkward_rows, prose


def brute(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, text, part in rows:
        if d is not None:
            least[text] = min(d, least.get(text, d))
    documents = []
    for d, text, part in rows:
        words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ")
        words = [w for w in words if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": d is not None and d > least[text],
        }
        documents.append((d, part, fails))
    found = {}
    shapley = Counter()
    for order in permutations("ABCDE"):
        alive = list(documents)
        gone = []
        for step, letter in enumerate(order, start=1):
            out = [x for x in alive if x[2][letter]]
            alive = [x for x in alive if not x[2][letter]]
            for part in {p for _, p, _ in documents}:
                mine = [x for x in out if x[1] == part]
                shapley[part, letter] += len(mine)
                found[part, "".join(order), step] = (
                    sum(x[1] == part for x in alive), len(mine),
                    sum(x[1] == part and x[2][letter] for x in gone),
                    sum(x[1] == part and [k for k in "ABCDE" if x[2][k]] == [letter] for x in documents),
                    sum(x[0] in good for x in mine), sum(x[0] in toxic for x in mine),
                )
            gone += out
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def collected(df):
    return {
        (r.part, r.filter_order, r.step): (
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley
        )
        for r in df.collect()
    }


def some_rows():
    rows = [(r[0], r[1] or "", r[3] or "") for r in awkward_rows()]
    for k in range(200, 260):
        text = prose(k % 17, 30 + k % 40) + ("#" if k % 3 == 0 else "") + (" AB" * (k % 5))
        rows.append((k, text, "s" if k % 2 else "t"))
    return rows + [(210, rows[-1][1], "t"), (None, rows[-1][1], "t"), (None, "", ""), (261, "#" * 9, "u\n")]


LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (202, 1, None), (203, None, 1), (210, 1, 1), (None, 1, 1), (9999, 1, 1)]


@pytest.mark.parametrize("hot_share, cells", [(1000, 1 << 20), (3, 1 << 8), (10**9, 16)])
def test_audit_as_all_orders_one_by_one(spark, monkeypatch, hot_share, cells):
    """With a full sketch everything is a possible repeat; the shares make all copies hot, or some."""
    monkeypatch.setattr(filter_audit, "HOT_SHARE", hot_share)
    monkeypatch.setattr(filter_audit, "MAX_CELLS", cells)
    monkeypatch.setattr(filter_audit, "SHARD_CELLS", min(cells, 16 if cells < 1 << 20 else 1 << 18))
    rows = some_rows()
    docs = spark.createDataFrame(
        [(d, t or None, None, p or None, None, *EXTRAS) for d, t, p in rows], SCHEMA
    ).repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert collected(filter_audit.audit(docs, labels)) == brute(rows, LABELS)


def test_sketch_never_clears_a_repeated_text(spark):
    texts = [f"text {k % 700}" if k % 3 else f"alone {k}" for k in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    sketch = filter_audit.merged_sketch(docs, "doc_id", "text")
    counts = Counter(texts)
    hits = sketch.may_repeat([filter_audit._digest(t) for t in texts])
    assert all(hit for hit, t in zip(hits, texts) if counts[t] > 1)
    cleared = sum(not hit for hit, t in zip(hits, texts) if counts[t] == 1)
    assert cleared > 0.9 * sum(counts[t] == 1 for t in texts)


def test_one_text_for_most_rows(spark):
    docs = spark.range(5000, numPartitions=9).selectExpr(
        "id AS doc_id", "if(id % 10 = 0, concat('word ', id), 'all the same') AS text", "'x' AS source"
    )
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = collected(filter_audit.audit(docs, labels))
    assert found["x", "EABCD", 1][:2] == (501, 4499)


def test_table_without_rows(spark, nothing, some_labels):
    assert filter_audit.audit(nothing, some_labels).count() == 0
