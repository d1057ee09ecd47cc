"""Quality rules and the quality classifier."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.llm import quality_model, quality_rules
from curbflow.llm.common import table

from .conftest import awkward_rows, prose


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    repeated = len(covered)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated,
        len(words) < 50 or 100 * repeated > 50 * len(words),
    )


def test_counts_against_brute_force(awkward, some_labels):
    found = quality_rules.apply_rules(awkward, some_labels).collect()
    got = [
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found
    ]
    assert sorted(map(str, got)) == sorted(str((row[0], *brute_counts(row[1]))) for row in awkward_rows())
    assert all(not r.kept for r in found if r.base_failed)
    # Three labels prove nothing: what passes the base rule is kept.
    assert all(r.kept for r in found if not r.base_failed)


def test_empty_tables(spark, nothing, awkward, some_labels):
    assert quality_rules.apply_rules(nothing, some_labels).count() == 0
    none = some_labels.where("false")
    judged = quality_rules.apply_rules(awkward, none)
    assert judged.where("kept = base_failed").count() == 0


@pytest.mark.parametrize(("k", "n", "p"), [(0, 100, 0.02), (3, 500, 0.01), (40, 5000, 0.01), (5, 100, 0.01), (19, 2000, 0.05), (900, 20000, 0.05)])
def test_binomial_tail(spark, k, n, p):
    log_of = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
    tail = math.fsum(math.exp(log_of(i) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
    row = spark.range(1).select(F.lit(k).alias("k"), F.lit(n).alias("n"))
    got = row.select(quality_rules.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
    assert got == (pytest.approx(tail, rel=1e-9) if k < n * p else 1.0)


def test_cutoffs_only_where_proven(spark):
    """Two strata: one with enough good documents for a cutoff, one without."""
    rows = [(i, "en", 0.0 if i % 1000 else 0.04) for i in range(1, 4001)] + [(5000 + i, "xx", 0.0) for i in range(50)]
    grid = {"measure": (0.02, 0.05)}
    measured = spark.createDataFrame(rows, "doc_id long, lang string, measure double").withColumn("base_failed", F.lit(False))
    labels = measured.select("doc_id", F.lit(1).alias("quality"))
    found = {r._stratum: r._max_measure for r in quality_rules.cutoffs(measured, labels, grid=grid, alpha=0.01).collect()}
    assert found == {"en": 0.02}
    judged = quality_rules.judge(measured, quality_rules.cutoffs(measured, labels, grid=grid, alpha=0.01), grid=grid)
    assert judged.where("NOT kept").count() == 4


def brute_cutoffs(rows, grid, alpha, delta):
    """Cutoffs by stratum from (stratum, {rule: measure}) of good documents, step by step."""
    strata = {}
    for stratum, measure in rows:
        strata.setdefault(stratum or "", []).append(measure)
    found = {}
    for stratum, good in strata.items():
        limits = {}
        for depth in range(max(map(len, grid.values()))):
            for rule, tried in grid.items():
                if depth >= len(tried):
                    continue
                tighter = {**limits, rule: sorted(tried)[-1 - depth]}
                k = sum(any(g[r] > c for r, c in tighter.items()) for g in good)
                tail = sum(math.comb(len(good), i) * alpha**i * (1 - alpha) ** (len(good) - i) for i in range(k + 1))
                if tail > delta / len(strata):
                    break
                limits = tighter
            else:
                continue
            break
        if limits:
            found[stratum] = limits
    return found


def test_cutoffs_against_brute_force(spark):
    """Strata of several sizes; some prove all steps, some a few, one none."""
    chance = random.Random(3)
    grid = {"one": (0.2, 0.5, 0.9), "two": (0.3, 0.6), "three": (0.1, 0.4, 0.7, 0.8)}
    plan = {"a": (400, 0.02), "b": (150, 0.3), "c": (30, 0.0), None: (700, 0.7), "d": (90, 0.0)}
    rows = [
        (lang, {r: chance.random() if chance.random() < spread / 3 else 0.05 for r in grid})
        for lang, (n, spread) in plan.items() for _ in range(n)
    ]
    frame = spark.createDataFrame(
        [(k, lang, False, *m.values()) for k, (lang, m) in enumerate(rows)],
        "doc_id long, lang string, base_failed boolean, one double, two double, three double",
    )
    labels = frame.selectExpr("doc_id", "1 AS quality")
    got = {
        r._stratum: {rule: r[f"_max_{rule}"] for rule in grid if r[f"_max_{rule}"] is not None}
        for r in quality_rules.cutoffs(frame, labels, grid=grid).collect()
    }
    wanted = brute_cutoffs(rows, grid, quality_rules.ALPHA, quality_rules.DELTA)
    assert got == wanted and 1 < len(wanted) < len(plan)


def test_method_rejects_what_the_base_rule_keeps(spark):
    judged = quality_rules.apply_rules(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels"))
    assert judged.where("NOT base_failed AND NOT kept").count() > 0


def test_many_strata_are_salted_with_the_same_verdicts(spark, monkeypatch):
    columns = [f"_max_{rule} double" for rule in quality_rules.GRID]
    limits = spark.createDataFrame(
        [("en", *[0.5] * len(columns)), ("", *[None] * len(columns))], "_stratum string, " + ", ".join(columns)
    )
    rows = [(k, ("en", "fr", None)[k % 3], k % 7 == 0, *[k / 100] * len(columns)) for k in range(100)]
    kinds = "doc_id long, lang string, base_failed boolean, " + ", ".join(f"{r} double" for r in quality_rules.GRID)
    measured = spark.createDataFrame(rows, kinds)
    small = sorted(quality_rules.judge(measured, limits).select("doc_id", "kept").collect())
    monkeypatch.setattr(quality_rules, "LIMIT_BYTES", 0)
    assert sorted(quality_rules.judge(measured, limits).select("doc_id", "kept").collect()) == small
    assert small == [(k, k % 7 != 0 and not (k % 3 == 0 and k > 50)) for k in range(100)]


def training_tables(spark):
    junk = [(2 * k, "THE!! " + prose(k, 30).upper().replace(" ", "!! ")) for k in range(150)]
    good = [(2 * k + 1, prose(1000 + k, 60)) for k in range(150)]
    docs = spark.createDataFrame(junk + good, "doc_id long, text string")
    return docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "0 AS toxic")


def test_classifier_on_held_out_documents(spark):
    docs, labels = training_tables(spark)
    rows = quality_model.classify(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)


def test_classifier_never_reads_held_out_labels(spark):
    docs, labels = training_tables(spark)
    other = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality_model.classify(docs, labels).select("doc_id", "score").collect()
    b = quality_model.classify(docs, other).select("doc_id", "score").collect()
    assert sorted(a) == sorted(b)


def test_classifier_on_awkward_rows(spark, awkward, nothing, some_labels):
    rows = quality_model.classify(awkward.select("doc_id", "text"), some_labels).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.classify(nothing.select("doc_id", "text"), some_labels).count() == 0
    plain = quality_model.classify(awkward.select("doc_id", "text"), some_labels.where("false"))
    assert {r.score for r in plain.collect()} == {0.5}


def test_scores_do_not_depend_on_neighbours():
    texts = ["", prose(1, 50), "a", prose(2, 9), "\n", prose(3, 500)]
    samples = []
    for label, text in enumerate([prose(7, 40), prose(8, 40).upper()]):
        every = np.concatenate([b for _, b in quality_model.features([text])])
        buckets, copies = np.unique(every, return_counts=True)
        samples.append((buckets, copies / len(every), label))
    model = quality_model.train(samples)
    together = model.scores(texts)
    assert [model.scores([t])[0] for t in texts] == pytest.approx(list(together), rel=1e-12)


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    """One labelled id repeated with many texts: the driver gets the bound, in any order of rows."""
    texts = [prose(k, 30) for k in range(60)]
    rows = [(1, t) for t in texts] * 3 + [(k, prose(100 + k, 30)) for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 30)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_model, "train", lambda samples: seen.append(samples))
    quality_model.fit(docs.repartition(3), labels, sample_docs=20)
    quality_model.fit(docs.repartition(7), labels, sample_docs=20)
    assert 0 < len(seen[0]) <= 20
    same = [[(b.tolist(), label) for b, _, label in samples] for samples in seen]
    assert same[0] == same[1]


def test_callers_columns_are_replaced_or_refused(spark, awkward, some_labels):
    judged = quality_model.classify(awkward, some_labels)
    assert judged.columns == [*awkward.columns, "held_out", "predicted"]
    assert judged.schema["score"].dataType.simpleString() == "double" and judged.count() == len(awkward_rows())
    with pytest.raises(ValueError, match="score"):
        quality_model.classify(awkward, some_labels, text_col="score")
