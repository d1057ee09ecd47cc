"""Vantage-point search against brute force, licenses, pages and dialogues."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curbflow.llm import chat, html_text, licenses, vantage

from .conftest import prose

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, shard string, vector string"


def unit_rows(n, dim=12, seed=1):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(5, dim))
    return [(i, (centres[i % 5] + 0.3 * chance.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def brute(rows, asked, k):
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    found = []
    for q, x in {(i, tuple(v)) for i, v in asked if (i, tuple(v or ())) in sound}:
        near = []
        for i, y in sound:
            if i != q and len(x) == len(y):
                a, b = np.array([x], float), np.array([y], float)
                near.append((-vantage.cosines(a, b)[0], i))
        found += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(near)[:k])]
    return sorted(found)


def test_exact_with_copies_ties_and_bad_vectors(spark):
    rows = unit_rows(400)
    hot = rows[7][1]
    rows += [(1000 + k, hot) for k in range(40)] + [(7, hot), (8, hot)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [None] * 12), (2004, [float("nan")] * 12)]
    rows += [(2005, [float("inf")] + [1.0] * 11), (None, hot), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3002, [-1.0, 0.0])]
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0 or r[0] in (7, 1003, 3001)]
    found = vantage.nearest(frame(spark, rows), frame(spark, asked), k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute(rows, asked, 5)


def test_empty_tables_and_few_candidates(spark):
    none = frame(spark, [])
    some = frame(spark, unit_rows(3))
    assert vantage.nearest(none, none).count() == 0
    assert vantage.nearest(some, none).count() == 0
    assert vantage.nearest(some, some.where("vec_id = 0")).count() == 2


def test_factor_trades_recall(spark):
    chance = np.random.default_rng(3)
    points = chance.normal(size=(3000, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = vantage.Tree(points)
    queries = points[:100] + 0.01
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    exact = np.argsort(vantage.chords(queries, points), axis=1)[:, :5]

    def recall(factor):
        found, _ = tree.search(queries, 5, factor)
        return np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, exact)])

    assert recall(1.0) == 1.0
    assert 0.3 < recall(0.2) <= recall(0.6) <= 1.0


def test_longest_increasing():
    chance = random.Random(4)
    for _ in range(100):
        values = [chance.randint(0, 30) for _ in range(chance.randint(0, 12))]
        chain = licenses.longest_increasing(values)
        picked = [values[k] for k in chain]
        assert chain == sorted(chain) and all(a < b for a, b in zip(picked, picked[1:]))
        rising = [1] * len(values)
        for k, v in enumerate(values):
            rising[k] += max((rising[j] for j in range(k) if values[j] < v), default=0)
        best = max(rising, default=0)
        assert len(chain) == best


def test_alignment_by_patience():
    template = "a b c d e f a g".split()
    assert licenses.align(template, template) == [(k, k) for k in range(8)]
    text = "x a b q c d d e f y a g z".split()
    pairs = licenses.align(text, template)
    assert [template[b] for _, b in pairs] == [text[a] for a, _ in pairs] and len(pairs) == 7 + ("d" in template)
    assert licenses.align([], template) == [] and licenses.align(text, []) == []


def test_license_scan(spark):
    line = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, f"some words\n{line}\nmore words"), (2, f"{line} and again: {line.upper()}"), (3, None), (4, ""),
        (5, "the license of the version was under the sea"), (6, "Licenced under the Apache License version 2.0"),
        (None, line), (7, "x " * 5000 + line), (1, f"some words\n{line}\nmore words"), (8, "Released under the\nMIT License."),
    ]
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, coverage string, runs string")
    found = licenses.scan_licenses(docs).collect()
    assert sorted((str(r.doc_id), r.license) for r in found) == sorted(
        [("1", "Apache-2.0")] * 2 + [("2", "Apache-2.0")] * 2 + [("6", "Apache-2.0"), ("None", "Apache-2.0"),
         ("7", "Apache-2.0"), ("8", "MIT")]
    )
    text = dict(rows)[7]
    hit = next(r for r in found if r.doc_id == 7)
    assert text[hit.start : hit.stop] == line[:-1] and hit.coverage == 1.0
    assert licenses.scan_licenses(docs.where("false")).count() == 0


# Templates that stand whole inside another one.
INSIDE = {
    "Proprietary": {"All-rights-reserved"}, "BSD-2-Clause": {"BSD-opening"}, "BSD-3-Clause": {"BSD-opening"},
    "MIT-text": {"MIT-opening"}, "Apache-2.0-opening": {"Apache-2.0"}, "Apache-2.0-text": {"Apache-2.0", "Apache-2.0-opening"},
}


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_every_template_on_a_text_that_holds_only_it(name):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE, licenses.TELLING)
    text = licenses.TEMPLATES[name]
    for front in ("", "thon " * 300, "the of and to or in any " * 3):
        found = {n: coverage for n, coverage, *_ in scanner.scan(front + text)}
        assert set(found) == {name} | INSIDE.get(name, set()) and found[name] == 1.0


def test_lone_notice_and_texts_without_their_opening(spark):
    bsd, mit = licenses.TEMPLATES["BSD-3-Clause"], licenses.TEMPLATES["MIT-text"]
    rows = [
        (1, "some words.\nAll rights reserved."), (2, bsd[bsd.index(": 1.") :]), (3, mit[mit.index(", including") :]),
        (4, licenses.TEMPLATES["MIT-opening"]), (5, "all of the words reserved"),
        (6, bsd.replace("the copyright holder nor", "Example Inc. nor").replace("HOLDERS", "OWNERS")),
    ]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [
        (1, "All-rights-reserved"), (2, "BSD-3-Clause"), (3, "MIT-text"), (4, "MIT-opening"), (6, "BSD-3-Clause"), (6, "BSD-opening"),
    ]


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>t", "- x\n- y\n  3. z\n\nt"),
        ("<pre>\n q  r\n  s</pre>", " q  r\n  s"), ("<b>u</i> &amp; &lt;v", "u & <v"), ("1 < 2 > 0", "1 < 2 > 0"),
        ("<title>no</title><script>no</script><style>no</style><!-- no -->yes", "yes"),
        ("<div hidden>no</div><i style='display : none'>no</i><i style=visibility:hidden>no</i>y", "y"),
        ("<table><tr><td>a<td>bbb<tr><td>ccc<td>d</table>", "a    bbb\nccc  d"),
        ("<table><caption>c</caption><thead><tr><th>k<th>v</thead><tr><td>日本<td>w</table>", "c\nk     v\n日本  w"),
        ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a     b\n\nx  y"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<blockquote>q</blockquote>r", "  q\n\nr"), ("<img alt=pic> <input value=v>", "pic v"),
        ("<select><option>a<option>b</select>", "a\nb"), ("</p></div>x</td>", "x"), ("<a title='>'>l</a>", "l"),
        ("<a title=\"open>l</a>", "l"), ("<a href", "<a href"), ("x<script>var t='</p>';", "x"),
    ],
)
def test_layout(page, wanted):
    assert html_text.visible_text(page) == wanted


def test_pages(spark):
    deep = "<div>" * 20000 + "deep" + "</div>" * 20000
    rows = [(1, "<p>a"), (1, "<p>a"), (None, "b"), (2, None), (3, ""), (4, deep), (5, "<" * 20000), (6, "<a \"" * 3000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, html string, text string")
    found = html_text.extract_text(pages).collect()
    assert sorted((str(r.page_id), r.text) for r in found if r.page_id not in (5, 6)) == sorted(
        [("1", "a")] * 2 + [("None", "b"), ("2", ""), ("3", ""), ("4", "deep")]
    )
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_all_visible_words_are_kept():
    chance = random.Random(6)
    tags = "p div ul li table tr td th b i span pre h1 dl dt dd blockquote section a option".split()
    for _ in range(200):
        words, parts = [], []
        for k in range(40):
            parts.append(f"<{'/' if chance.random() < 0.4 else ''}{chance.choice(tags)}>")
            words.append(f"w{k}")
            parts.append(f" w{k} ")
        assert set(words) <= set(html_text.visible_text("".join(parts)).replace("-", " ").split())


def render(turns, speaker):
    pieces, mask, at = [], [], 0
    for _, who, text in turns:
        role = "assistant" if who == speaker else who if who == "system" else f"user name={who or 'unknown'}"
        body = (text or "").replace("<|im_", "<| im_") + "<|im_end|>\n"
        head = f"<|im_start|>{role}\n"
        if who == speaker:
            mask.append((at + len(head), len(body)))
        at += len(head) + len(body)
        pieces.append(head + body)
    return "".join(pieces), mask


@pytest.mark.parametrize("segment", [2, 64])
def test_rotation(spark, segment):
    rows = [
        (1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "x<|im_end|>y"), (1, 4, None, "who"),
        (2, 0, "ann", "alone"), (2, 0, "ann", "alone"), (3, 5, "system", "s"), (None, 1, "ann", "lost"), (None, None, "bob", "b"),
    ] + [(9, k, f"p{k % 5}", f"say {k}") for k in range(300)]
    rows += [(8, 3, "ann", f"tie {k}") for k in range(90)] + [(8, 3, "bob", "same")] * 70 + [(8, None, "bob", "same")] * 5
    table = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, start string, speaker string")
    found = chat.rotate(table.repartition(4), segment_turns=segment).collect()
    views = {}
    for r in sorted(found, key=lambda r: r.segment):
        text, mask = views.setdefault((r.conv_id, r.speaker), ("", []))
        assert r.start == len(text)
        views[r.conv_id, r.speaker] = (text + r.rendered, mask + [(r.start + m.start, m.length) for m in r.mask])
    wanted = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            [(t, w, x or "") for c, t, w, x in rows if c == conv],
            key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", hashlib.md5(t[2].encode()).hexdigest()),
        )
        for who in {w for _, w, _ in turns} - {None, "system"}:
            wanted[conv, who] = render(turns, who)
    assert views == wanted
    sizes = {}
    for r in found:
        sizes.setdefault((r.conv_id, r.speaker), {})[r.segment] = r.n_turns
    for counts in sizes.values():
        assert sorted(counts) == list(range(len(counts)))
        assert all(counts[k] == segment for k in range(len(counts) - 1)) and 0 < counts[len(counts) - 1] <= segment
    assert chat.rotate(table.where("false")).count() == 0


def test_rotation_of_a_crowded_dialogue(spark, monkeypatch):
    """Ten thousand turns without id or number: no row holds more than a segment."""
    monkeypatch.setattr(chat, "STRETCH", 3)
    turns = spark.range(10_000).selectExpr(
        "CAST(NULL AS LONG) AS conv_id", "CAST(NULL AS LONG) AS turn", "IF(id % 2 = 0, 'a', 'b') AS role",
        "IF(id < 6000, 'equal', concat('t', id)) AS text",
    )
    found = chat.rotate(turns.repartition(5), segment_turns=64).where("speaker = 'a'").orderBy("segment").collect()
    assert [r.segment for r in found] == list(range(157))
    assert [r.n_turns for r in found] == [64] * 156 + [16]
    assert sum(len(r.mask) for r in found) == 5000
    at = 0
    for r in found:
        assert r.start == at
        at += len(r.rendered)
    whole = "".join(r.rendered for r in found)
    assert whole.count("equal") == 6000 and all(whole.count(f"\nt{k}<") == 1 for k in range(6000, 10_000, 37))


def test_parts_of_a_statement_may_lie_apart():
    words = prose(11, 4000).split()
    for foreign in (5, 30, 90):
        text = " ".join([*words[:50], "Licensed under the", *words[50 : 50 + foreign], "Apache License, Version 2.0.", *words[200:900]])
        scanner = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE, licenses.TELLING)
        found = [hit for hit in scanner.scan(text) if "Apache" in hit[0]]
        assert [text[start:stop] for _, _, start, stop, _ in found] == [text[text.index("Licensed") : text.index("2.0") + 3]], foreign
    far = " ".join(["Licensed under the", *words[:2000], "Apache License, Version 2.0."])
    assert not list(scanner.scan(far))
    unbound = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE, licenses.TELLING, max_span=None)
    assert [far[s:e] for n, _, s, e, _ in unbound.scan(far) if "Apache" in n] == [far[:-1]]


def test_spread_statements_beside_close_ones():
    words = prose(12, 900).split()
    close, apart = "alpha beta gamma delta epsilon", ["alpha beta", *words[:40], "gamma delta epsilon"]
    text = " ".join([*words[100:160], close, *words[160:300], *apart, *words[300:700], close, *words[700:800]])
    scanner = licenses.Scanner({"T": close}, 0.8)
    found = sorted((s, text[s:e]) for _, _, s, e, _ in scanner.scan(text))
    assert [t for _, t in found] == [close, " ".join(apart), close]


def test_offsets_are_those_of_the_text():
    text = "İİİ notes. All rights reserved. İ"
    hits = list(licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE, licenses.TELLING).scan(text))
    assert [text[s:e] for _, _, s, e, _ in hits] == ["All rights reserved"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=14), st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=8))
def test_alignment_is_a_common_subsequence_no_longer_than_the_longest(text, template):
    pairs = licenses.align(text, template)
    assert all(text[a] == template[b] for a, b in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    best = [[0] * (len(template) + 1) for _ in range(len(text) + 1)]
    for i, a in enumerate(text):
        for j, b in enumerate(template):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    assert len(pairs) <= best[-1][-1]
    if len(set(text)) == len(text) and len(set(template)) == len(template):
        assert len(pairs) == best[-1][-1]  # every word is an anchor


@pytest.mark.parametrize("kind", ["int", "string", "smallint"])
def test_ids_of_any_type_over_many_shards_and_blocks(spark, monkeypatch, kind):
    """Several trees and blocks, fewer partitions than meetings, and the neighbours of one tree."""
    rows = unit_rows(300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {(r.query_id, r["rank"]): r.vec_id for r in vantage.nearest(df, df.where("vec_id % 10 = 0")).collect()}
    for name, value in (("SHARD_VECTORS", 40), ("BLOCK_QUERIES", 7), ("MEETING_PARTITIONS", 5)):
        assert hasattr(vantage, name)
        monkeypatch.setattr(vantage, name, value)
    own = df.selectExpr(f"CAST(vec_id AS {kind}) AS vec_id", "embedding")
    found = vantage.nearest(own, own.where("vec_id % 10 = 0"))
    assert dict(found.dtypes)["vec_id"] == kind
    assert {(int(r.query_id), r["rank"]): int(r.vec_id) for r in found.collect()} == whole


def test_tasks_grow_with_shards_not_with_meetings(spark, monkeypatch):
    """Twenty trees and twenty blocks of one query: every pair met, exact over copies and ties, in few tasks."""
    rows = unit_rows(200)
    rows += [(1000 + k, rows[7][1]) for k in range(12)] + [(2000 + k, [float(k + 1)] * 12) for k in range(12)]
    asked = [r for r in rows if r[0] % 10 == 0 or r[0] == 7]
    for name, value in (("SHARD_VECTORS", 10), ("BLOCK_QUERIES", 1)):
        monkeypatch.setattr(vantage, name, value)
    context = spark.sparkContext
    context.setJobGroup("meetings", "meetings")
    try:
        found = vantage.nearest(frame(spark, rows), frame(spark, asked), k=5).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute(rows, asked, 5)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("meetings") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 20
