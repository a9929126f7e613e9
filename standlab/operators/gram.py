"""Least-squares fits from sufficient statistics.

One distributed pass reduces the rows to means and cross-products; only matrices of
the size of the model are ever solved.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from standlab.session import small_side

WIDE = 5  # columns up to which global cross-products are plain aggregates


def partial_sums(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Add up a fixed-length vector computed from row batches.

    Every task emits one vector, Spark adds them by position, and the driver receives
    ``size`` numbers whatever the number of rows or tasks.
    """
    def run(batches):
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += kernel(pdf.to_numpy(dtype=float))
        yield pd.DataFrame({"part": [total]})

    parts = df.mapInPandas(run, "part array<double>")
    added = parts.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for row in added.collect():
        out[row["i"]] = row["v"]
    return out


def moments(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, means and centred cross-products of complete rows, as arrays per group."""
    rows = df.dropna(subset=cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    n = F.count(F.lit(1))
    return rows.groupBy(*(by or [])).agg(
        n.alias("n"), F.array(*[F.avg(c) for c in cols]).alias("mean"),
        F.array(*[F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")) * n
                  for i, j in pairs]).alias("cross"))


def unpack(cross, k: int) -> np.ndarray:
    """Upper triangle back to a symmetric matrix."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = cross
    return m + np.triu(m, 1).T


def global_moments(df: DataFrame, cols: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and centred cross-product matrix over all complete rows."""
    k = len(cols)
    if k <= WIDE:
        row = moments(df, cols).first()
        return row["n"], np.array(row["mean"], float), unpack(row["cross"], k)
    rows = df.dropna(subset=cols).select(*[F.col(c).cast("double").alias(c) for c in cols])
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("m")).first()
    mean = np.array(first["m"], float)

    def kernel(x):
        x = x - mean
        return (x.T @ x).ravel()

    return first["n"], mean, partial_sums(rows, kernel, k * k).reshape(k, k)


def solve_ols(n: float, mean: np.ndarray, cross: np.ndarray) -> dict:
    """Coefficients and fit statistics; the last column is the response."""
    sxx, sxy, syy = cross[:-1, :-1], cross[:-1, -1], cross[-1, -1]
    p = len(sxx) + 1
    inverse = np.linalg.pinv(sxx) if len(sxx) else np.zeros((0, 0))
    slope = inverse @ sxy
    sse = max(float(syy - slope @ sxy), 0.0)
    dof = n - p
    s2 = sse / dof if dof > 0 else np.nan
    centre = mean[:-1]
    cov = np.empty((p, p))
    cov[1:, 1:] = inverse
    cov[0, 1:] = cov[1:, 0] = -inverse @ centre
    cov[0, 0] = 1 / n + centre @ inverse @ centre
    beta = np.concatenate([[mean[-1] - slope @ centre], slope])
    r2 = 1 - sse / syy if syy > 0 else np.nan
    loglik = -n / 2 * (np.log(2 * np.pi * sse / n) + 1) if sse > 0 else np.nan
    return {"beta": beta, "cov": cov * s2, "n": n, "sse": sse, "dof": dof, "sigma2": s2, "r2": r2,
            "adj_r2": 1 - (1 - r2) * (n - 1) / dof if dof > 0 else np.nan,
            "rmse": np.sqrt(sse / n), "loglik": loglik, "aic": -2 * loglik + 2 * (p + 1)}


FIT = ["sse", "dof", "sigma2", "r2", "adj_r2", "rmse", "loglik", "aic"]


def ols(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per group: term names, estimates, standard errors and fit statistics."""
    by = by or []
    terms, k = ["(Intercept)", *xs], len(xs) + 1
    if not by:
        n, mean, cross = global_moments(df, [*xs, y])
        fit = solve_ols(n, mean, cross)
        row = (n, terms, fit["beta"].tolist(), np.sqrt(np.diag(fit["cov"])).tolist(),
               *[float(fit[c]) for c in FIT])
        return df.sparkSession.createDataFrame([row], "n long, term array<string>, estimate array<double>, "
                                               "se array<double>, " + ", ".join(f"{c} double" for c in FIT))
    table = moments(df, [*xs, y], by)
    out_cols = [*by, "n", "term", "estimate", "se", *FIT]
    keys = "".join(f"`{c}` {t}, " for c, t in table.dtypes if c in by)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.n <= k:
                    continue
                fit = solve_ols(r.n, np.array(r.mean, float), unpack(r.cross, k))
                rows.append([*[getattr(r, c) for c in by], r.n, terms, fit["beta"],
                             np.sqrt(np.diag(fit["cov"])), *[fit[c] for c in FIT]])
            yield pd.DataFrame(rows, columns=out_cols)

    schema = (keys + "n long, term array<string>, estimate array<double>, se array<double>, "
              + ", ".join(f"{c} double" for c in FIT))
    return table.mapInPandas(solve, schema)


def coefficients(fits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long coefficient table."""
    return fits.select(*(by or []), F.inline(F.arrays_zip("term", "estimate", "se")))


def dummies(df: DataFrame, factors: dict[str, list[str]],
            crossed: list[tuple[str, str]] = ()) -> tuple[DataFrame, list[str]]:
    """0/1 columns for factor levels after the first, and products with numeric columns."""
    made: dict[str, list[str]] = {}
    for factor, levels in factors.items():
        names = [f"{factor}_{lv}" for lv in levels[1:]]
        df = df.withColumns({n: (F.col(factor) == lv).cast("double") for n, lv in zip(names, levels[1:])})
        made[factor] = names
    extra = []
    for a, b in crossed:
        for u in made.get(a, [a]):
            for v in made.get(b, [b]):
                df = df.withColumn(f"{u}_x_{v}", F.col(u) * F.col(v))
                extra.append(f"{u}_x_{v}")
    return df, [n for names in made.values() for n in names] + extra


def linear_predictor(intercept: float, weights: dict[str, float]) -> Column:
    return sum((F.col(c) * float(w) for c, w in weights.items()), F.lit(float(intercept)))


def predict(df: DataFrame, fits: DataFrame, xs: list[str], by: list[str], out: str) -> DataFrame:
    """Score rows with their group's coefficients."""
    beta = F.col("estimate")
    line = F.get(beta, F.lit(0))
    for i, x in enumerate(xs, 1):
        line = line + F.get(beta, F.lit(i)) * F.col(x)
    return df.join(small_side(fits.select(*by, "estimate")), by, "left").withColumn(out, line).drop("estimate")


def fit_stats(df: DataFrame, obs: str, pred: str, p: int, by: list[str] | None = None) -> DataFrame:
    """Bias, absolute bias, R2, adjusted R2, RMSE and likelihood over complete pairs."""
    res = F.col(obs) - F.col(pred)
    n = F.col("n")
    return (df.dropna(subset=[obs, pred]).groupBy(*(by or []))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(res).alias("mb"), F.avg(F.abs(res)).alias("mab"),
                 F.sum(res * res).alias("sse"), (F.var_pop(obs) * F.count(F.lit(1))).alias("sst"))
            .withColumn("rsq", 1 - F.try_divide("sse", "sst"))
            .withColumn("adj_rsq", 1 - F.try_divide((1 - F.col("rsq")) * (n - 1), n - p - 1))
            .withColumn("rmse", F.sqrt(F.col("sse") / n))
            .withColumn("loglik", -n / 2 * (F.log(2 * F.pi() * F.col("sse") / n) + 1))
            .withColumn("aic", -2 * F.col("loglik") + 2 * (p + 1)))


def vif(df: DataFrame, xs: list[str]) -> dict[str, float]:
    """Variance inflation factors: diagonal of the inverse correlation matrix."""
    _, _, cross = global_moments(df, xs)
    d = np.sqrt(np.diag(cross))
    return dict(zip(xs, np.diag(np.linalg.inv(cross / np.outer(d, d))).tolist()))


def vif_pair(df: DataFrame, x1: str, x2: str) -> DataFrame:
    r = F.corr(x1, x2)
    return df.dropna(subset=[x1, x2]).agg((1 / (1 - r * r)).alias("vif"))


BOXCOX_GRID = [-2.0 + 4.0 * i / 99 for i in range(100)]


def boxcox_profile(df: DataFrame, y: str, grid: list[float] = BOXCOX_GRID) -> DataFrame:
    """Profile log-likelihood of the power transform of a positive response.

    The grid is unfolded inside each task and combined before the shuffle.
    """
    lam, v = F.col("exponent"), F.col("_y")
    z = F.when(F.abs(lam) < 1e-12, F.log(v)).otherwise((F.pow(v, lam) - 1) / lam)
    rows = df.filter(F.col(y) > 0).select(F.col(y).alias("_y")).withColumn(
        "exponent", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return (rows.groupBy("exponent").agg(F.count(F.lit(1)).alias("n"), F.var_pop(z).alias("_v"),
                                       F.avg(F.log(v)).alias("_l"))
            .select("exponent", (-F.col("n") / 2 * F.log("_v") + (lam - 1) * F.col("n") * F.col("_l"))
                    .alias("loglik")))


def boxcox_best(df: DataFrame, y: str, grid: list[float] = BOXCOX_GRID) -> DataFrame:
    return boxcox_profile(df, y, grid).agg(F.max_by("exponent", "loglik").alias("exponent"))


def log_height_prediction(a: Column, b: Column, x: Column, sigma: Column) -> Column:
    """Back-transformed log model with the half-variance correction."""
    return F.exp(a + b * x + sigma * sigma / 2)


def fit_index(df: DataFrame, response: str, rmse: float | Column) -> DataFrame:
    """Index comparable across transforms of a logged response: rmse over the
    geometric mean of the derivative 1 / y."""
    value = F.lit(rmse) if isinstance(rmse, float) else rmse
    return df.filter(F.col(response) > 0).agg(
        (value / F.exp(F.avg(F.log(1 / F.col(response))))).alias("fit_index"))


def variance_power(df: DataFrame, y: str, x: str, weight_on: str, thetas: list[float]) -> DataFrame:
    """Profile likelihood of a straight line whose error spread grows as d^theta.

    All exponents are weighed in one pass; the straight line per exponent is closed-form.
    """
    rows = df.dropna(subset=[y, x]).filter(F.col(weight_on) > 0).select(
        F.col(y).alias("_y"), F.col(x).alias("_x"), F.log(weight_on).alias("_l"),
        F.explode(F.array(*[F.lit(float(th)) for th in thetas])).alias("theta"))
    w = F.exp(-2 * F.col("theta") * F.col("_l"))
    x_, y_ = F.col("_x"), F.col("_y")
    s = rows.groupBy("theta").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * x_).alias("wx"),
        F.sum(w * y_).alias("wy"), F.sum(w * x_ * x_).alias("wxx"), F.sum(w * x_ * y_).alias("wxy"),
        F.sum(w * y_ * y_).alias("wyy"), F.sum("_l").alias("sl"))
    c = F.col
    sxx, sxy, syy = (c("wxx") - c("wx") * c("wx") / c("w"), c("wxy") - c("wx") * c("wy") / c("w"),
                     c("wyy") - c("wy") * c("wy") / c("w"))
    return (s.withColumn("slope", sxy / sxx)
            .withColumn("intercept", (c("wy") - c("slope") * c("wx")) / c("w"))
            .withColumn("rss", syy - c("slope") * sxy)
            .withColumn("loglik", -c("n") / 2 * (F.log(2 * F.pi() * c("rss") / c("n")) + 1)
                        - c("theta") * c("sl"))
            .select("theta", "intercept", "slope", "rss", "loglik"))
