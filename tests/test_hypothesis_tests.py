import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.functions import tails
from curbflow.operators import hypothesis, normality
from curbflow.operators.order_stats import rank_distinct


def frame(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "hour int, journey_time double")


def test_tails_against_tables():
    assert tails.normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.t_two_sided(1.96, 1e12) == pytest.approx(2 * tails.normal_sf(1.96))
    assert tails.f_sf(3.354130829, 2, 27) == pytest.approx(0.05, abs=1e-7)
    assert tails.chi2_sf(18.30703805, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_sf(0.5, 3) + (1 - tails.chi2_sf(0.5, 3)) == 1
    assert tails.beta_cdf(0.3, 2, 3) == pytest.approx(0.3483, abs=1e-4)
    assert tails.f_sf(4.0, 5, 2e8) == pytest.approx(tails.f_sf(4.0, 5, 5e7), abs=1e-6)
    # Upper 5 % points of the studentised range.
    assert tails.studentized_range_sf(3.506, 3, 27) == pytest.approx(0.05, abs=2e-4)
    assert tails.studentized_range_sf(3.877, 3, 10) == pytest.approx(0.05, abs=2e-4)
    assert tails.studentized_range_sf(3.314, 3, 1e9) == pytest.approx(0.05, abs=2e-4)
    # Two groups: the range test is the t test with q = t * sqrt 2.
    assert tails.studentized_range_sf(2.228138852 * math.sqrt(2), 2, 10) == pytest.approx(0.05, abs=1e-6)


def test_two_groups_f_is_t_squared_and_tukey_agrees(spark):
    groups = {1: [1, 2, 3, 4, 7], 2: [4, 5, 6, 9, 11]}
    df = frame(spark, groups)
    f = hypothesis.anova(df).first()
    a, b = (np.array(groups[g], float) for g in (1, 2))
    pooled = (a.var(ddof=1) + b.var(ddof=1)) / 2
    t = (a.mean() - b.mean()) / math.sqrt(pooled * 2 / 5)
    assert f.statistic == pytest.approx(t * t)
    assert f.p_value == pytest.approx(tails.t_two_sided(t, 8))
    pair = hypothesis.tukey_hsd(df, always=True).first()
    assert pair.q == pytest.approx(abs(t) * math.sqrt(2))
    assert pair.p_adjusted == pytest.approx(f.p_value, abs=1e-6)
    assert hypothesis.tukey_hsd(frame(spark, {1: [1, 2, 3], 2: [1, 2, 3]})).count() == 0


def test_welch_by_hand(spark):
    df = frame(spark, {8: [20, 22, 19, 24], 3: [28, 32, 25, 30, 29]})
    row = hypothesis.welch_t(df, "journey_time", F.col("hour"), 8, 3).first()
    a, b = np.array([20, 22, 19, 24.0]), np.array([28, 32, 25, 30, 29.0])
    e1, e2 = a.var(ddof=1) / 4, b.var(ddof=1) / 5
    assert row.statistic == pytest.approx((a.mean() - b.mean()) / math.sqrt(e1 + e2))
    assert row.df == pytest.approx((e1 + e2) ** 2 / (e1**2 / 3 + e2**2 / 4))


def brute_ranks(values):
    return [sum(o < v for o in values) + (sum(o == v for o in values) + 1) / 2 for v in values]


def test_rank_kernel_against_brute_force(spark):
    random.seed(3)
    values = [random.choice([-2.5, 0.0, 1e-9, 3.0, 3.0000001, 700.0]) + random.randint(0, 3) for _ in range(300)]
    freq = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n"))
    ranked = rank_distinct(freq.withColumnRenamed("n", "copies"), "v", freq, "n")
    got = {r.v: r.avg_rank for r in ranked.collect()}
    assert got == dict(zip(values, brute_ranks(values)))


def test_kruskal_and_mann_whitney_with_ties(spark):
    groups = {8: [1, 2, 2, 3, 5, 5, 9], 3: [2, 4, 5, 6, 6, 8]}
    df = frame(spark, groups)
    values = groups[8] + groups[3]
    ranks = brute_ranks(values)
    n1, n2, n = 7, 6, 13
    r1 = sum(ranks[:n1])
    ties = sum(t**3 - t for t in (values.count(v) for v in set(values)))
    h = (12 / (n * (n + 1)) * (r1**2 / n1 + sum(ranks[n1:]) ** 2 / n2) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    row = hypothesis.kruskal(df).first()
    assert row.statistic == pytest.approx(h) and row.df == 1
    u = r1 - n1 * (n1 + 1) / 2
    sigma = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma
    mw = hypothesis.mann_whitney_hours(df).first()
    assert mw.statistic == u and mw.p_value == pytest.approx(min(1, 2 * tails.normal_sf(z)))
    # Two groups: H is the squared deviate without continuity correction.
    assert h == pytest.approx(((u - n1 * n2 / 2) / sigma) ** 2)


def test_mann_whitney_without_a_side(spark):
    row = hypothesis.mann_whitney_hours(frame(spark, {8: [1, 2]})).first()
    assert (row.method, row.statistic, row.p_value, row.n2) == ("insufficient", None, None, 0)


def test_spearman_of_monotone_and_partly_missing_data(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 100.0), (3.0, 1000.0), (4.0, None)], "journey_time double, trip_distance double")
    row = hypothesis.spearman(df).first()
    assert (row.rho, row.n, row.p_value, row.strength, row.sign) == (1.0, 3, 0.0, "Strong", "positive")
    tied = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (2.0, 2.0), (5.0, 2.0), (6.0, 9.0)], "journey_time double, trip_distance double")
    x, y = brute_ranks([1, 2, 2, 5, 6]), brute_ranks([3, 1, 2, 2, 9])
    assert hypothesis.spearman(tied).first().rho == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_levene_uses_medians(spark):
    groups = {1: [1, 2, 3, 10], 2: [5, 5, 6, 7, 20]}
    moved = {g: np.abs(np.array(v) - np.median(v)) for g, v in groups.items()}
    wanted = hypothesis.anova(frame(spark, moved)).first()
    assert hypothesis.levene(frame(spark, groups)).first().statistic == pytest.approx(wanted.statistic)


def test_ols_by_hand_and_degenerate_groups(spark):
    rows = [(1, x, y) for x, y in ((1.0, 2.0), (2.0, 4.5), (3.0, 5.5), (4.0, 9.0))]
    rows += [(2, 1.0, 1.0), (2, 2.0, 3.0), (3, 1.0, 1.0), (4, 2.0, 1.0), (4, 2.0, 5.0), (4, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "hour int, trip_distance double, journey_time double")
    got = {r.hour: r for r in hypothesis.ols_by_group(df).collect()}
    assert set(got) == {1, 2, 4}
    x, y = np.array([1, 2, 3, 4.0]), np.array([2, 4.5, 5.5, 9])
    slope, intercept = np.polyfit(x, y, 1)
    error = ((y - slope * x - intercept) ** 2).sum()
    t = slope / math.sqrt(error / 2 / ((x - 2.5) ** 2).sum())
    assert got[1].slope == pytest.approx(slope) and got[1].t_value == pytest.approx(t)
    assert got[1].p_value == pytest.approx(tails.t_two_sided(t, 2))
    assert got[2].slope == 2.0 and got[2].p_value is None
    assert got[4].slope is None


def test_shapiro_published_example(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = normality.shapiro(frame(spark, {0: weights})).first()
    assert row.statistic == pytest.approx(0.788815, abs=1e-6)
    assert row.p_value == pytest.approx(0.006704, abs=1e-6)


def test_shapiro_chunks_and_small_samples(spark, monkeypatch):
    random.seed(5)
    values = [round(random.gauss(0, 1), 1) for _ in range(500)]
    df = frame(spark, {0: values})
    whole = normality.shapiro(df).first()
    monkeypatch.setattr(normality, "_CHUNK", 3)
    split = normality.shapiro(df).first()
    assert split.statistic == pytest.approx(whole.statistic) and split.n == 500
    monkeypatch.undo()
    assert normality.shapiro(frame(spark, {0: [1, 2, 3]})).first().statistic is None
    assert normality.shapiro(frame(spark, {0: [4, 4, 4, 4, 4]})).first().statistic is None
    assert 0.9 < normality.shapiro(frame(spark, {0: [1, 2, 3, 4]})).first().statistic <= 1


def test_normal_quantile_inverts_the_tail():
    p = np.array([1e-12, 1e-4, 0.02, 0.3, 0.5, 0.9, 1 - 1e-6])
    z = normality.normal_quantile(p)
    assert [tails.normal_sf(-v) for v in z] == pytest.approx(list(p), rel=1e-9)


def test_python_functions_need_no_package_on_the_workers(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    parcel = tmp_path / "parcel"
    parcel.write_bytes(cloudpickle.dumps((tails._tail, normality._score_sums.func, normality._statistic.func)))
    script = (
        "import sys, pandas as pd; from pyspark import cloudpickle\n"
        f"tail, sums, statistic = cloudpickle.loads(open({str(parcel)!r}, 'rb').read())\n"
        "assert 'curbflow' not in sys.modules\n"
        "assert abs(tail('t', 2.228138852, 10.0, None) - 0.05) < 1e-8\n"
        "print(sums(pd.Series([1]), pd.Series([3]), pd.Series([3])).m[0])"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd="/", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert abs(float(done.stdout)) < 1e-12


def test_t_quantiles_and_exact_rank_sums():
    from itertools import combinations

    # Published two-sided 5 % points of t.
    for df, point in ((1, 12.7062047), (2, 4.30265273), (5, 2.57058184), (30, 2.04227246), (1e9, 1.95996398)):
        assert tails.t_quantile(0.05, df) == pytest.approx(point, rel=1e-8)
    for df in (1, 3, 17, 1e4):
        for p in (1.0, 0.6, 0.05, 1e-6):
            assert tails.t_two_sided(tails.t_quantile(p, df), df) == pytest.approx(p, rel=1e-9)
    for n1, n2 in ((1, 1), (1, 6), (3, 4), (5, 5), (2, 7)):
        sums = [sum(chosen) - n1 * (n1 - 1) // 2 for chosen in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            share = sum(s <= u for s in sums) / len(sums)
            assert tails.rank_sum_cdf(u, n1, n2) == pytest.approx(share, rel=1e-12)
            assert tails.rank_sum_cdf(u, n2, n1) == pytest.approx(share, rel=1e-12)
    # Eight against thousands: the counts stay exact enough to meet the normal limit.
    n1, n2 = 8, 20_000
    u, sd = n1 * n2 / 2 - 2 * math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 1
    assert tails.rank_sum_cdf(u, n1, n2) == pytest.approx(tails.normal_sf(2) * sd, abs=2e-3)


def test_small_sides_without_ties_are_exact(spark):
    rows = [(1, float(v)) for v in (1, 2, 3)] + [(2, float(v)) for v in (4, 5, 6, 7)]
    df = spark.createDataFrame(rows, "s int, v double")
    found = hypothesis.mann_whitney(df, "v", F.col("s"), 1, 2).first()
    # Published: U = 0 with 3 and 4 values has a two-sided p of 2 / 35.
    assert (found.statistic, found.method) == (0.0, "exact")
    assert found.p_value == pytest.approx(2 / 35)
    tied = spark.createDataFrame([*rows, (2, 1.0)], "s int, v double")
    assert hypothesis.mann_whitney(tied, "v", F.col("s"), 1, 2).first().method == "asymptotic"
    many = spark.createDataFrame([(1 + k % 2, float(k)) for k in range(18)], "s int, v double")
    assert hypothesis.mann_whitney(many, "v", F.col("s"), 1, 2).first().method == "asymptotic"


def test_bootstrap_interval(spark):
    import random

    from curbflow.operators import demand

    chance = random.Random(4)
    rows = [(k, k % 3, chance.gauss(10, 2)) for k in range(900)] + [(1000, 7, 5.0), (1001, None, 5.0), (1002, 8, None)]
    df = spark.createDataFrame(rows, "id long, hour int, journey_time double")
    found = {r.hour: r for r in demand.mean_bootstrap(df.repartition(3), ["id"], replicates=400).collect()}
    again = {r.hour: r for r in demand.mean_bootstrap(df.repartition(7), ["id"], replicates=400).collect()}
    assert found.keys() == again.keys() == {0, 1, 2, 7}
    for hour, row in found.items():  # the same draw however the rows lie
        assert row.boot_low == pytest.approx(again[hour].boot_low) and row.boot_high == pytest.approx(again[hour].boot_high)
    interval = {r.hour: r for r in demand.mean_interval(df).collect()}
    for hour in (0, 1, 2):  # many rows: both intervals agree
        width = interval[hour].ci_high - interval[hour].ci_low
        assert found[hour].boot_low == pytest.approx(interval[hour].ci_low, abs=width / 8)
        assert found[hour].boot_high == pytest.approx(interval[hour].ci_high, abs=width / 8)
    assert (found[7].boot_low, found[7].boot_high) == (5.0, 5.0)
    assert interval[7].ci_low is None and interval[8].n == 0
