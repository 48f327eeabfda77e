"""Tail probabilities for test statistics. They run on aggregated rows only: a few per test, not per sample."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an, b = -i * (i - a), b + 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def _rows(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(x) for x in row) else f(*map(float, row)) for row in zip(*columns, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(lambda v, k: gamma_q(k / 2, v / 2) if k > 0 else float("nan"), x, df)


@F.pandas_udf(T.DoubleType())
def f_sf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _rows(lambda v, k, n: beta_i(n / 2, k / 2, n / (n + k * v)) if k > 0 and n > 0 else float("nan"), x, a, b)


@F.pandas_udf(T.DoubleType())
def t_sf2(x: pd.Series, df: pd.Series) -> pd.Series:
    """Both tails of Student's t."""
    return _rows(lambda v, k: beta_i(k / 2, 0.5, k / (k + v * v)) if k > 0 else float("nan"), x, df)


@F.pandas_udf(T.DoubleType())
def log_factorial(n: pd.Series) -> pd.Series:
    return _rows(lambda k: math.lgamma(k + 1), n)
