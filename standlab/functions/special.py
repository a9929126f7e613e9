"""Tail probabilities for result rows: incomplete beta, t, F, normal, studentised range."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if not (a > 0 and b > 0) or math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def f_tail(f: float, df1: float, df2: float) -> float:
    if f is None or math.isnan(f):
        return math.nan
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    if t is None or math.isnan(t):
        return math.nan
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def _norm_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.array([math.erf(v) for v in np.ravel(x) / math.sqrt(2)])).reshape(np.shape(x))


def _range_cdf(w: np.ndarray, k: int, nodes=np.polynomial.legendre.leggauss(96)) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    z = 8.0 * nodes[0]
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = _norm_cdf(z[None, :]) - _norm_cdf(z[None, :] - w[:, None])
    return k * (8.0 * nodes[1] * density * inner ** (k - 1)).sum(axis=1)


def studentised_range_tail(q: float, k: int, df: float) -> float:
    """P(studentised range of k means exceeds q), integrating over the scale estimate."""
    if q is None or math.isnan(q) or df <= 0:
        return math.nan
    if q <= 0:
        return 1.0
    x, wt = np.polynomial.legendre.leggauss(64)
    spread = 8.0 / math.sqrt(2 * df)
    low, high = max(1e-8, 1 - spread), 1 + spread
    s = low + (high - low) * (x + 1) / 2
    log_density = (math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
                   + (df - 1) * np.log(s) - df * s * s / 2)
    total = ((high - low) / 2 * wt * np.exp(log_density) * _range_cdf(q * s, k)).sum()
    return float(min(1.0, max(0.0, 1 - total)))


def _on_rows(fn, *cols):
    """Apply a tail function to a handful of result rows."""
    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([fn(*map(float, row)) for row in zip(*parts)], dtype="float64")

    # Spark reads the number of inputs and the kind of function from the signature
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf(two if len(cols) == 2 else three, "double")(*cols)


def p_f(f, df1, df2) -> Column:
    return _on_rows(f_tail, f, df1, df2)


def p_t(t, df) -> Column:
    return _on_rows(t_tail, t, df)


def p_range(q, k, df) -> Column:
    return _on_rows(lambda a, b, c: studentised_range_tail(a, int(b), c), q, k, df)
