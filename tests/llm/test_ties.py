"""Vantage-point search with more ties than a search keeps, against brute force."""

import numpy as np

from curbflow.llm import vantage

from .test_search import brute, frame, unit_rows


def test_ties_of_any_number(spark):
    chance = np.random.default_rng(4)
    line = [1.0, 2.0, -3.0, 0.5] * 3
    rows = [(int(i), [x * 2.0**k for x in line]) for k, i in enumerate(chance.permutation(100))]
    rows += [(1000 + int(i), chance.choice([-1.0, 1.0], 12).tolist()) for i in chance.permutation(600)]
    rows += [(2000 + int(i), (np.eye(12)[k % 12] * (k + 1)).tolist()) for k, i in enumerate(chance.permutation(150))]
    rows += [(3000, [x + k / 1024 for x in line]) for k in range(40)]  # one id in all near places
    rows += [(5000 + i, v) for i, v in unit_rows(300)]
    asked = [r for r in rows if r[0] % 50 == 0 and r[0] != 3000] + [r for r in rows if r[0] == 3000][:2]
    found = vantage.nearest(frame(spark, rows), frame(spark, asked), k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute(rows, asked, 5)
