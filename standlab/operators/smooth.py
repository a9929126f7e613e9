"""Local and penalised smoothing of collapsed curves.

Both work on tables of distinct predictor values per group (diameter classes, profile
levels), never on raw trees.  Local fits take memory in proportion to a group's points,
the penalised smoother also time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def local_regression(points: DataFrame, by: list[str], x: str, y: str, span: float = 0.75,
                     degree: int = 2) -> DataFrame:
    """Locally weighted polynomial through each distinct x, tricube weights."""
    def fit(pdf):
        pdf = pdf.sort_values(x)
        u, v = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        q = max(min(int(np.floor(span * len(u) + 1e-5)), len(u)), 1)
        smooth = np.empty(len(u))
        low = 0
        for i, at in enumerate(u):
            while low + q < len(u) and u[low + q] - at < at - u[low]:  # the q nearest lie together
                low += 1
            near, value = u[low:low + q], v[low:low + q]
            d = np.abs(near - at)
            h = d.max()
            w = np.clip(1 - (d / h) ** 3, 0, None) ** 3 if h > 0 else (d == 0).astype(float)
            k = min(degree, max(int((w > 0).sum()) - 1, 0))
            basis = np.vander(near - at, k + 1, increasing=True)
            root = np.sqrt(w)
            smooth[i] = np.linalg.lstsq(basis * root[:, None], value * root, rcond=None)[0][0]
        return pdf[[*by, x]].assign(smooth=smooth)

    keys = "".join(f"`{c}` {t}, " for c, t in points.select(*by).dtypes)
    rows = points.select(*by, x, y).dropna()
    return rows.groupBy(*by).applyInPandas(fit, keys + f"`{x}` double, smooth double")


def _whittaker(v: np.ndarray, penalty: float) -> np.ndarray:
    """Solve (I + penalty D'D) z = v for second differences D, whose matrix has five diagonals."""
    n = len(v)
    if n < 3:
        return v
    diagonal, first, second = np.ones(n), np.zeros(n), np.zeros(n)
    for offset, weight in ((0, 1), (1, 4), (2, 1)):
        diagonal[offset:n - 2 + offset] += penalty * weight
    first[:n - 2] -= 2 * penalty
    first[1:n - 1] -= 2 * penalty
    second[:n - 2] += penalty
    d, e, f, z = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):  # L D L' with unit lower bands e and f
        d[i] = diagonal[i] - (e[i - 1] ** 2 * d[i - 1] if i else 0) - (f[i - 2] ** 2 * d[i - 2] if i > 1 else 0)
        e[i] = (first[i] - (e[i - 1] * f[i - 1] * d[i - 1] if i else 0)) / d[i]
        f[i] = second[i] / d[i]
        z[i] = v[i] - (e[i - 1] * z[i - 1] if i else 0) - (f[i - 2] * z[i - 2] if i > 1 else 0)
    z /= d
    for i in range(n - 2, -1, -1):
        z[i] -= e[i] * z[i + 1] + (f[i] * z[i + 2] if i + 2 < n else 0)
    return z


def smooth_profile(profile: DataFrame, by: list[str], x: str, y: str, penalty: float = 10.0) -> DataFrame:
    """Penalised second-difference smoother along an even axis, clipped at 0."""
    def fit(pdf):
        pdf = pdf.sort_values(x)
        return pdf[[*by, x]].assign(smooth=np.maximum(_whittaker(pdf[y].to_numpy(float), penalty), 0.0))

    keys = "".join(f"`{c}` {t}, " for c, t in profile.select(*by).dtypes)
    return profile.select(*by, x, y).groupBy(*by).applyInPandas(fit, keys + f"`{x}` double, smooth double")
