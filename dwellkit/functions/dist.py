"""Distribution tails for the last step of a test, on one-row results.

Plain functions for the driver, and Arrow wrappers for a statistic that sits in a (small)
result table.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def gamma_sf(s: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(s, x)."""
    if x <= 0.0:
        return 1.0
    lead = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        n = s
        while abs(term) > 1e-17 * abs(total):
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * lead
    b, tiny = x + 1.0 - s, 1e-300
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 5000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return lead * h


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2.0, x / 2.0)


def t_quantile(p: float, df: float) -> float:
    """Inverse of the t distribution function by bisection."""
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    lo, hi = 0.0, 1.0
    while t_sf(hi, df) > 1.0 - p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if t_sf(mid, df) > 1.0 - p else (lo, mid)
    return 0.5 * (lo + hi)


def binom_sf(k: float, n: float) -> float:
    """P(X >= k) for n fair trials."""
    return 1.0 if k <= 0 else beta_inc(k, n - k + 1.0, 0.5)


def _apply(fn, *cols):
    def one(*v):
        return float("nan") if any(x is None or x != x for x in v) else fn(*map(float, v))
    return pd.Series([one(*v) for v in zip(*cols)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_sf_col(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_sf, t, df)


@F.pandas_udf(DoubleType())
def t_quantile_col(p: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_quantile, p, df)


@F.pandas_udf(DoubleType())
def chi2_sf_col(x: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(chi2_sf, x, df)


@F.pandas_udf(DoubleType())
def binom_sf_col(k: pd.Series, n: pd.Series) -> pd.Series:
    return _apply(binom_sf, k, n)


def t_two_sided(t: Column, df: Column) -> Column:
    return 2.0 * t_sf_col(F.abs(t), df.cast("double"))
