"""Shapiro-Wilk normality test (Royston 1995) from value counts.

W needs normal scores of all ranks. Copies of a value share a run of ranks, so
the table of distinct values with their rank ranges is enough; ranges are cut
into chunks, scores of a chunk are summed in one vectorised call, and the rest
is one aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import known
from ..functions.tails import tail_probability
from ..functions.trip import significance
from .order_stats import rank_distinct

_CHUNK = 100_000


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.DoubleType()) for name in names])


# Rational approximation of the normal quantile (Wichura 1988, AS 241),
# numerator and denominator for the centre, the near tail and the far tail.
_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
     4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
     1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
     2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
     4.2313330701600911252e1, 1.0),
)
_NEAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
     1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
     4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
     1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
     2.05319162663775882187e0, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
     2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
     5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
     7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
     5.99832206555887937690e-1, 1.0),
)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    q = p - 0.5
    tail = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    centre, near = 0.180625 - q * q, tail - 1.6
    far = tail - 5
    outer = np.where(
        tail <= 5,
        np.polyval(_NEAR[0], near) / np.polyval(_NEAR[1], near),
        np.polyval(_FAR[0], far) / np.polyval(_FAR[1], far),
    )
    return np.where(
        np.abs(q) <= 0.425,
        q * np.polyval(_CENTRE[0], centre) / np.polyval(_CENTRE[1], centre),
        np.sign(q) * outer,
    )


def rank_scores(ranks: np.ndarray, n: float) -> np.ndarray:
    """Expected normal order statistics (Blom)."""
    return normal_quantile((ranks - 0.375) / (n + 0.25))


@F.pandas_udf(_doubles("m", "m2"))
def _score_sums(first: pd.Series, last: pd.Series, n: pd.Series) -> pd.DataFrame:
    rows = []
    for lo, hi, size in zip(first, last, n):
        scores = rank_scores(np.arange(lo, hi + 1, dtype="float64"), size)
        rows.append((scores.sum(), (scores * scores).sum()))
    return pd.DataFrame(rows, columns=["m", "m2"])


# Royston's polynomials, highest power first.
_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
_SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
_LARGE_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
_LARGE_LOG_SD = (0.0030302, -0.082676, -0.4803)
_SMALL_GAMMA = (0.459, -2.273)
_SMALL_MEAN = (-0.0006714, 0.025054, -0.39978, 0.5440)
_SMALL_LOG_SD = (-0.0020322, 0.062767, -0.77857, 1.3822)


@F.pandas_udf(_doubles("w", "z"))
def _statistic(
    n: pd.Series, total: pd.Series, squares: pd.Series, scored: pd.Series,
    low1: pd.Series, low2: pd.Series, high2: pd.Series, high1: pd.Series,
) -> pd.DataFrame:
    """W and its normal deviate from the sums of one sample.

    ``total`` is the sum of squared scores, ``squares`` that of deviations from
    the mean, ``scored`` the sum of deviation times score, ``low1..high1`` the
    two smallest and two largest values.
    """
    rows = []
    for size, mm, ss, xm, a, b, c, d in zip(n, total, squares, scored, low1, low2, high2, high1):
        if size < 3 or not ss > 0:
            rows.append((np.nan, np.nan))
            continue
        if size == 3:
            numerator = (d - a) * np.sqrt(0.5)
        else:
            m1, m2 = rank_scores(np.array([size, size - 1.0]), size)
            u = 1 / np.sqrt(size)
            a1 = m1 / np.sqrt(mm) + np.polyval(_LAST, u)
            if size > 5:
                a2 = m2 / np.sqrt(mm) + np.polyval(_SECOND, u)
                phi = (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
                inner = xm - m1 * (d - a) - m2 * (c - b)
                numerator = inner / np.sqrt(phi) + a1 * (d - a) + a2 * (c - b)
            else:
                phi = (mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)
                numerator = (xm - m1 * (d - a)) / np.sqrt(phi) + a1 * (d - a)
        w = min(1.0, numerator * numerator / ss)
        rows.append((w, _deviate(w, float(size))))
    return pd.DataFrame(rows, columns=["w", "z"])


def _deviate(w: float, n: float) -> float:
    if w >= 1:
        return -np.inf
    if n > 11:
        log_n = np.log(n)
        return (np.log(1 - w) - np.polyval(_LARGE_MEAN, log_n)) / np.exp(np.polyval(_LARGE_LOG_SD, log_n))
    if n < 4:
        return np.nan
    room = np.polyval(_SMALL_GAMMA, n) - np.log(1 - w)
    if room <= 0:
        return np.inf
    return (-np.log(room) - np.polyval(_SMALL_MEAN, n)) / np.exp(np.polyval(_SMALL_LOG_SD, n))


def shapiro(df: DataFrame, value: str = "journey_time") -> DataFrame:
    """One row: W, p, number of rows. NULL for fewer than four or constant values."""
    x = F.col(value).cast("double")
    freq = df.where(known(x)).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    per_value = freq.select("v", F.col("n").alias("copies"))
    ranked = rank_distinct(per_value, "v", freq, "n").select("v", "copies", "below")
    size = freq.agg(F.sum("n")).scalar().cast("double")
    mean = freq.agg(F.sum(F.col("v") * F.col("n")) / F.sum("n")).scalar()
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / _CHUNK))
    pieces = (
        ranked.withColumn("_c", F.explode(chunks))
        # Hot values make many chunks; spread them before scoring.
        .repartition("v", "_c")
        .withColumns({"_n": size, "_mean": mean})
        .withColumn("_first", F.col("below") + F.col("_c") * _CHUNK + 1)
        .withColumn(
            "_last", F.col("below") + F.least(F.col("copies"), (F.col("_c") + 1) * _CHUNK)
        )
        .withColumn("_s", _score_sums("_first", "_last", "_n"))
    )
    off = F.col("v") - F.col("_mean")
    rows = F.col("_last") - F.col("_first") + 1

    def holder(rank):
        return F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("v")))

    n = F.col("_n")
    sums = pieces.agg(
        F.sum(rows).alias("n"), F.sum("_s.m2").alias("_mm"), F.sum(rows * off * off).alias("_ss"),
        F.sum(off * F.col("_s.m")).alias("_xm"),
        holder(F.lit(1)).alias("_x1"), holder(F.lit(2)).alias("_x2"),
        holder(n - 1).alias("_y2"), holder(n).alias("_y1"),
    )
    scored = sums.withColumn(
        "_w",
        _statistic(
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0))
              for c in ("n", "_mm", "_ss", "_xm", "_x1", "_x2", "_y2", "_y1")]
        ),
    ).select(
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when((F.col("n") > 3) & ~F.isnan("_w.w"), F.col("_w.w")).alias("statistic"),
        F.when((F.col("n") > 3) & ~F.isnan("_w.z"), F.col("_w.z")).alias("z"),
    )
    return scored.withColumn("p_value", tail_probability("normal_upper", F.col("z"))).select(
        "statistic", "n", "p_value", significance(F.col("p_value")).alias("verdict")
    )


def shapiro_route(
    df: DataFrame, pu: int, do: int, value: str = "journey_time"
) -> DataFrame:
    """The same for one directed route."""
    return shapiro(df.where((F.col("PULocationID") == pu) & (F.col("DOLocationID") == do)), value)
