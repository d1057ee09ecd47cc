"""Tail probabilities of test statistics.

Applied to result rows only (a handful to a few hundred), through one Arrow UDF.
Methods are the textbook ones: continued fractions for the incomplete beta and
gamma functions, trapezoids for the studentised range.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Beyond this many degrees of freedom the limiting distribution is used.
_MANY = 1e8
_TINY = 1e-300


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fraction(first: float, terms) -> float:
    """Modified Lentz evaluation of first + a1/(b1 + a2/(b2 + ...))."""
    value = first or _TINY
    c, d = value, 0.0
    for a, b in terms:
        d = 1 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        step = c * d
        value *= step
        if abs(step - 1) < 1e-15:
            break
    return value


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    limit = 300 + int(10 * math.sqrt(a + b))

    def terms():
        yield 1.0, 1.0
        for m in range(limit):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    return math.exp(front) / a * _fraction(0.0, terms())


def gamma_sf(x: float, a: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    limit = 300 + int(20 * math.sqrt(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, limit):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    return front * _fraction(
        0.0, ((1.0 if i == 0 else -i * (i - a), x + 2 * i + 1 - a) for i in range(limit))
    )


def t_two_sided(t: float, df: float) -> float:
    if df > _MANY:
        return 2 * normal_sf(abs(t))
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    if d2 > _MANY:
        return gamma_sf(d1 * f / 2, d1 / 2)
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(x / 2, df / 2)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(-z / math.sqrt(2))


def studentized_range_sf(q: float, k: float, df: float) -> float:
    """P(range of k normals over an independent scale exceeds q).

    Trapezoids over the scale and over the smallest of the normals: both integrands
    vanish smoothly at the ends, where this rule gains digits with every point.
    """
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 97)
    below, density = _normal_cdf(z), np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (z[1] - z[0])
    # Logarithm t of the scale s, df * s^2 being chi-square: ten deviations either side,
    # further down where few degrees of freedom leave a long tail. The density is
    # written as a ratio to its value at 1, so that no large terms cancel at any df.
    deviation = 1 / math.sqrt(2 * df)
    t = np.arange(-max(10 * deviation, 40 / df), 10 * deviation, deviation / 3)
    weight = np.exp(df * (t - np.expm1(2 * t) / 2))
    core = np.clip(below - _normal_cdf(z - q * np.exp(t)[:, None]), 0, 1) ** (k - 1)
    return max(0.0, 1 - float(weight @ (core @ density) * k / weight.sum()))


def t_quantile(p: float, df: float) -> float:
    """The point that a t variable exceeds in size with probability ``p``.

    Newton steps on the two-sided tail, kept between two bounds that close in.
    """
    if p >= 1:
        return 0.0
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > p:
        low, high = high, 2 * high
    x = (low + high) / 2
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) if df < 1e6 else (
        1 / math.sqrt(2 * math.pi)
    )
    for _ in range(200):
        gap = t_two_sided(x, df) - p
        low, high = (x, high) if gap > 0 else (low, x)
        step = x + gap / (2 * scale * math.exp(-(df + 1) / 2 * math.log1p(x * x / df)))
        step = step if low < step < high else (low + high) / 2
        if abs(step - x) <= 1e-14 * x:
            break
        x = step
    return x


def rank_sum_cdf(u: float, n1: float, n2: float) -> float:
    """P(U <= u) of the rank-sum statistic of two samples without ties, counted exactly.

    The arrangements by U are the coefficients of a Gaussian binomial, built up one
    member of the smaller sample at a time; each stage counts arrangements itself.
    """
    few, many = sorted((int(n1), int(n2)))
    size = int(u) + 1
    counts = np.zeros(size)
    counts[0] = 1.0
    for i in range(1, few + 1):
        if many + i < size:
            counts[many + i :] = counts[many + i :] - counts[: size - many - i].copy()
        for start in range(min(i, size)):
            counts[start::i] = np.cumsum(counts[start::i])
    return float(counts.sum()) / math.comb(few + many, few)


_TAILS = {
    "normal": lambda x, a, b: 2 * normal_sf(abs(x)),
    "normal_upper": lambda x, a, b: normal_sf(x),
    "t": lambda x, a, b: t_two_sided(x, a),
    "f": f_sf,
    "chi2": lambda x, a, b: chi2_sf(x, a),
    "range": studentized_range_sf,
    "t_point": lambda x, a, b: t_quantile(x, a),
    "rank_sum": rank_sum_cdf,
}


def _tail(kind: str, x: float, a: float, b: float) -> float:
    needed = {"f": 3, "range": 3, "rank_sum": 3, "t": 2, "chi2": 2, "t_point": 2}.get(kind, 1)
    arguments = (x, a, b)[:needed]
    if any(v is None or math.isnan(v) for v in arguments) or any(v <= 0 for v in arguments[1:]):
        return math.nan
    if math.isinf(x):
        return 0.0
    found = _TAILS[kind](x, a, b)
    return found if kind == "t_point" else min(1.0, found)


def tail_probability(kind: str, x: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """p-value column: 'normal' and 't' two-sided, 'rank_sum' a lower tail, the others upper tails.

    'rank_sum' takes both sample sizes. 't_point' goes the other way: the point with the
    two-sided tail ``x``. NULL where undefined.
    """
    if kind not in _TAILS:
        raise ValueError(f"unknown distribution {kind!r}")

    @F.pandas_udf(T.DoubleType())
    def probability(xs: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([_tail(kind, *row) for row in zip(xs, first, second)], dtype="float64")

    blank = F.lit(None)
    args = [(blank if c is None else c).cast("double") for c in (x, a, b)]
    p = probability(*args)
    return F.when(~F.isnan(p), p)
