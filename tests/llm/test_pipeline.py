"""The pipeline against plain Python, stage by stage on its own input."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from curbflow.llm import quality_model
from curbflow.llm.common import table
from curbflow.llm.queries import BYTE_BPE, QUERIES

from .conftest import prose
from .test_join import brute
from .test_quality import brute_counts

SF_DIR = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def ids(rows):
    return sorted(str(r.doc_id) for r in rows)


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF_DIR, "labels")


def stage_inputs(spark, awkward):
    return {"documents": table(spark, SF_DIR, "documents"), "awkward": awkward}


@pytest.mark.parametrize("source", ["documents", "awkward"])
def test_filters(spark, awkward, labels, source):
    docs = stage_inputs(spark, awkward)[source]
    rows = docs.collect()

    kept = STAGE["quality classifier"](spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    model = quality_model.fit(docs, labels)
    scores = model.scores([r.text or "" for r in rows])
    assert ids(kept.collect()) == ids(r for r, s in zip(rows, scores) if s >= corpus_pipeline.SCORE)

    kept = STAGE["quality rules"](spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    # With these few labels no cutoff can be proven, so the base rule decides.
    assert ids(kept.collect()) == ids(r for r in rows if not brute_counts(r.text)[-1])

    kept = STAGE["near duplicates"](spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    ordered = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    known = brute([(k, r.text) for k, r in enumerate(ordered)])
    assert ids(kept.collect()) == ids(r for k, r in enumerate(ordered) if known[k][1] == k)


def test_two_texts_under_one_id(spark):
    copied, alone, twice = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, copied), (5, copied + " more"), (5, alone), (6, twice), (6, twice + " more"), (7, twice), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id, r.text or "") for r in STAGE["near duplicates"](spark, docs, SF_DIR).collect())
    assert kept[:2] == [(1, copied), (5, alone)] and kept[3:] == [(8, ""), (8, "")]
    assert kept[2] in rows[3:5]


@pytest.mark.parametrize("written", [False, True])
def test_one_row_of_copies_stays(spark, tmp_path, written):
    """Repeated rows, copies without id and a column that hides file positions."""
    text, other = prose(4, 90), prose(5, 90)
    rows = [(1, text, "a")] * 4 + [(None, text, "b")] * 3 + [(None, other, "c")] * 3 + [(9, "", "d")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _metadata string")
    if written:
        docs.drop("_metadata").repartition(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = STAGE["near duplicates"](spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(str, found)) == sorted(map(str, [(1, text), (None, other), (9, ""), (9, "")]))


def test_empty_input(spark, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF_DIR).count() == 0


def test_last_stage_and_whole_run(spark):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    texts = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    assert 0 < len({p.doc_id for p in pieces}) < len(texts)
    total = {}
    for p in pieces:
        own = np.array(tokenizer.encode(texts[p.doc_id], add_special_tokens=False).ids + [0], "<u4")
        assert p.doc_tokens == len(own)
        assert p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert all(n == len(tokenizer.encode(texts[d], add_special_tokens=False).ids) + 1 for d, n in total.items())


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
