"""Hypothesis tests from distributed aggregates.

Each test is one or a few grouped aggregations; only its final row (or one row
per group or pair) reaches the tail-probability UDF. Rank tests work on counts
per distinct value, so no group is collected or sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import known
from ..functions.tails import tail_probability
from ..functions.trip import sign_label, significance, strength
from ..session import settle
from .order_stats import exact_quantiles, rank_distinct

ALPHA = 0.05
# A side of at most this many rows, without ties, gets the exact rank-sum distribution.
EXACT_ROWS = 8


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """n, mean and sum of squared deviations per known group."""
    x = F.col(value).cast("double")
    return (
        df.where(known(x) & F.col(group).isNotNull()).groupBy(group)
        .agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("ss"))
    )


def _anova_row(moments: DataFrame) -> DataFrame:
    """One row with between and within sums of squares and F."""
    n, mean = F.col("n"), F.col("mean")
    grand = moments.agg(F.sum(n * mean) / F.sum(n)).scalar()
    off = mean - F.col("_grand")
    sums = moments.withColumn("_grand", grand).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"),
        F.sum("ss").alias("ss_within"), F.sum(n * off * off).alias("ss_between"),
    )
    return (
        sums.withColumns(
            {"df_between": F.col("k") - 1, "df_within": F.col("total") - F.col("k")}
        )
        .withColumn("mse", F.col("ss_within") / F.nullif(F.col("df_within"), F.lit(0)))
        .withColumn(
            "statistic",
            F.col("ss_between") / F.nullif(F.col("df_between"), F.lit(0))
            / F.nullif(F.col("mse"), F.lit(0.0)),
        )
    )


def _with_p(row: DataFrame, p: Column) -> DataFrame:
    return row.withColumn("p_value", p).withColumn("verdict", significance(F.col("p_value"), ALPHA))


def anova(df: DataFrame, value: str = "journey_time", group: str = "hour") -> DataFrame:
    """One-way analysis of variance."""
    row = _anova_row(settle(group_moments(df, value, group)))
    return _with_p(
        row, tail_probability("f", F.col("statistic"), F.col("df_between"), F.col("df_within"))
    ).select("statistic", "df_between", "df_within", "p_value", "verdict")


def levene(df: DataFrame, value: str = "journey_time", group: str = "hour") -> DataFrame:
    """Equality of variances: analysis of variance of distances from the group median."""
    medians = exact_quantiles(df, [group], value, {"_median": 0.5})
    spread = df.select(group, value).join(medians, group).withColumn(
        "_distance", F.abs(F.col(value) - F.col("_median"))
    )
    return anova(spread, "_distance", group)


def _frequency(df: DataFrame, value: str, group: Column) -> DataFrame:
    x = F.col(value).cast("double")
    return (
        df.where(known(x)).select(x.alias("v"), group.alias("g")).where(F.col("g").isNotNull())
        .groupBy("v", "g").agg(F.count(F.lit(1)).alias("n"))
    )


def _rank_sums(freq: DataFrame) -> DataFrame:
    """Rows, rank sum and tie term per group, ties given their average rank.

    Values are ranked once over all groups and the ranks joined back to the
    counts per value and group. A value tied t times adds t^3 - t to the tie
    term, shared out over its rows.
    """
    per_value = freq.groupBy("v").agg(F.sum("n").alias("copies"))
    ranks = rank_distinct(per_value, "v", freq, "n").selectExpr(
        "v", "avg_rank", "cast(copies AS double) * copies - 1 AS _tie"
    )
    return freq.join(ranks, "v").groupBy("g").agg(
        F.expr("sum(n) AS n"), F.expr("sum(n * avg_rank) AS rank_sum"), F.expr("sum(n * _tie) AS tie")
    )


def kruskal(df: DataFrame, value: str = "journey_time", group: str = "hour") -> DataFrame:
    """Rank analysis of variance with tie correction."""
    sums = _rank_sums(_frequency(df, value, F.col(group)))
    n = F.col("total").cast("double")
    row = sums.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum("tie").alias("tie"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_r"),
    ).select(
        (
            (F.lit(12.0) / (n * (n + 1)) * F.col("_r") - 3 * (n + 1))
            / F.nullif(1 - F.col("tie") / (n * n * n - n), F.lit(0.0))
        ).alias("statistic"),
        (F.col("k") - 1).alias("df"), F.col("total").alias("n"),
    )
    return _with_p(row, tail_probability("chi2", F.col("statistic"), F.col("df")))


def mann_whitney(df: DataFrame, value: str, side: Column, first, second) -> DataFrame:
    """Two-sided rank test of ``side == first`` against ``side == second``.

    A side of at most ``EXACT_ROWS`` rows in a comparison without ties takes the exact
    null distribution, others the normal approximation with tie and continuity
    correction. ``method`` says which, or 'insufficient' when a side has no rows.
    """
    chosen = F.when(side == F.lit(first), F.lit(1)).when(side == F.lit(second), F.lit(2))
    sums = _rank_sums(_frequency(df, value, chosen))
    one, two = F.col("g") == 1, F.col("g") == 2
    zero = F.lit(0).cast("bigint")
    row = sums.agg(
        F.coalesce(F.sum(F.when(one, F.col("n"))), zero).alias("n1"),
        F.coalesce(F.sum(F.when(two, F.col("n"))), zero).alias("n2"),
        F.sum(F.when(one, F.col("rank_sum"))).alias("_r1"), F.sum("tie").alias("_tie"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    enough = (F.col("n1") > 0) & (F.col("n2") > 0)
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_tie") / F.nullif(n * (n - 1), F.lit(0.0))))
    row = row.withColumns({"statistic": F.when(enough, u), "_sigma": F.when(enough, sigma)})
    larger = F.greatest(F.col("statistic"), n1 * n2 - F.col("statistic"))
    row = row.withColumn("z", (larger - n1 * n2 / 2 - 0.5) / F.nullif(F.col("_sigma"), F.lit(0.0)))
    method = (
        F.when(~enough, "insufficient")
        .when((F.least("n1", "n2") <= EXACT_ROWS) & (F.col("_tie") == 0), "exact").otherwise("asymptotic")
    )
    row = row.withColumn("method", method)
    few = F.when(F.col("method") == "exact", F.least(F.col("statistic"), n1 * n2 - F.col("statistic")))
    p = F.when(F.col("method") == "exact", 2 * tail_probability("rank_sum", few, n1, n2)).when(
        F.col("z").isNotNull(), 2 * tail_probability("normal_upper", F.col("z"))
    )
    return _with_p(row, F.when(p.isNotNull(), F.least(F.lit(1.0), p))).select(
        "statistic", "n1", "n2", "p_value", "verdict", "method"
    )


def mann_whitney_hours(
    df: DataFrame, value: str = "journey_time", peak: int = 8, off_peak: int = 3
) -> DataFrame:
    return mann_whitney(df, value, F.col("hour"), peak, off_peak)


def spearman(df: DataFrame, left: str = "journey_time", right: str = "trip_distance") -> DataFrame:
    """Rank correlation of two columns over rows where both are known."""
    x, y = F.col(left).cast("double"), F.col(right).cast("double")
    pairs = df.where(known(x) & known(y)).groupBy(x.alias("x"), y.alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )

    def ranks(column: str, name: str) -> DataFrame:
        per_value = pairs.groupBy(column).agg(F.sum("n").alias("copies"))
        return rank_distinct(per_value, column, pairs, "n").select(
            column, F.col("avg_rank").alias(name)
        )

    ranked = pairs.join(ranks("x", "rx"), "x").join(ranks("y", "ry"), "y")
    total = pairs.agg(F.sum("n")).scalar()
    # The mean rank is known, so covariance and variances need a single pass.
    centre = (F.col("_total") + 1) / 2
    a, b, n = F.col("rx") - centre, F.col("ry") - centre, F.col("n")
    row = ranked.withColumn("_total", total).agg(
        F.sum("n").alias("n"), F.sum(n * a * b).alias("_ab"),
        F.sum(n * a * a).alias("_aa"), F.sum(n * b * b).alias("_bb"),
    )
    row = row.withColumn("rho", F.col("_ab") / F.nullif(F.sqrt(F.col("_aa") * F.col("_bb")), F.lit(0.0)))
    df_, r = F.col("n") - 2, F.col("rho")
    t = r * F.sqrt(df_ / F.nullif((1 + r) * (1 - r), F.lit(0.0)))
    t = F.when(F.abs(r) >= 1, F.signum(r) * F.lit(float("inf"))).otherwise(t)
    row = row.withColumn("statistic", t)
    return _with_p(row, tail_probability("t", F.col("statistic"), df_)).select(
        "rho", "n", "statistic", "p_value", "verdict",
        strength(r).alias("strength"), sign_label(r).alias("sign"),
    )


def tukey_hsd(
    df: DataFrame, value: str = "journey_time", group: str = "hour", alpha: float = ALPHA,
    always: bool = False,
) -> DataFrame:
    """All group pairs (one row each) of Tukey-Kramer comparisons.

    Empty unless the analysis of variance is significant or ``always`` is set.
    Pairs are formed among group summaries, never among trips.
    """
    groups = settle(group_moments(df, value, group))
    overall = _anova_row(groups).withColumn(
        "_p", tail_probability("f", F.col("statistic"), F.col("df_between"), F.col("df_within"))
    )
    left = groups.select(F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("mean").alias("m1"))
    right = groups.select(F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("mean").alias("m2"))
    fixed = overall.first()
    spread = F.sqrt(F.lit(fixed["mse"]) / 2 * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    pairs = (
        left.join(right, F.col("group1") < F.col("group2"))
        .withColumn("mean_difference", F.col("m2") - F.col("m1"))
        .withColumn("q", F.abs("mean_difference") / F.nullif(spread, F.lit(0.0)))
    )
    if not always and not (fixed["_p"] is not None and fixed["_p"] < alpha):
        pairs = pairs.where(F.lit(False))
    p = tail_probability("range", F.col("q"), F.lit(fixed["k"]), F.lit(fixed["df_within"]))
    return pairs.withColumn("p_adjusted", p).select(
        "group1", "group2", "mean_difference", "q", "p_adjusted",
        (F.col("p_adjusted") < alpha).alias("reject"),
    )


def ols_by_group(
    df: DataFrame, y: str = "journey_time", x: str = "trip_distance", group: str = "hour"
) -> DataFrame:
    """Straight-line fit of y on x per group with more than one known pair.

    NULL slope where x does not vary, NULL p with two points.
    """
    b, a = F.col(y).cast("double"), F.col(x).cast("double")
    fit = (
        df.where(known(a) & known(b) & F.col(group).isNotNull()).groupBy(group)
        .agg(
            F.regr_count(b, a).alias("n"), F.regr_sxx(b, a).alias("_sxx"),
            F.regr_syy(b, a).alias("_syy"), F.regr_sxy(b, a).alias("_sxy"),
        )
        .where(F.col("n") > 1)
    )
    sxx, syy = F.nullif(F.col("_sxx"), F.lit(0.0)), F.nullif(F.col("_syy"), F.lit(0.0))
    fit = fit.withColumns(
        {"slope": F.col("_sxy") / sxx, "r_squared": F.col("_sxy") * F.col("_sxy") / (sxx * syy)}
    )
    error = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    df_ = F.nullif(F.col("n") - 2, F.lit(0))
    t = F.col("slope") / F.nullif(F.sqrt(error / (df_ * sxx)), F.lit(0.0))
    return fit.withColumn("t_value", t).select(
        group, "n", "slope", "r_squared", "t_value",
        tail_probability("t", F.col("t_value"), df_).alias("p_value"),
    )


def welch_t(df: DataFrame, value: str, side: Column, first, second) -> DataFrame:
    """Unequal-variance t test of ``side == first`` against ``side == second``."""
    x = F.col(value).cast("double")

    def part(which):
        return F.when(side == F.lit(which), x)

    columns = []
    for i, which in ((1, first), (2, second)):
        columns += [
            F.count(part(which)).alias(f"n{i}"), F.avg(part(which)).alias(f"mean{i}"),
            F.var_samp(part(which)).alias(f"_v{i}"),
        ]
    row = df.where(known(x)).agg(*columns)
    e1, e2 = F.col("_v1") / F.col("n1"), F.col("_v2") / F.col("n2")
    both = F.nullif(e1 + e2, F.lit(0.0))
    row = row.withColumns(
        {
            "statistic": (F.col("mean1") - F.col("mean2")) / F.sqrt(both),
            "df": both * both / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1)),
        }
    )
    return _with_p(row, tail_probability("t", F.col("statistic"), F.col("df"))).select(
        "statistic", "df", "n1", "n2", "mean1", "mean2", "p_value", "verdict"
    )
