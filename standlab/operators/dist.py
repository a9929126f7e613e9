"""Distribution summaries and fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from standlab.functions import columns as C
from standlab.operators.aggregates import exact_quantiles
from standlab.operators.joins import match_nulls
from standlab.operators.gram import partial_sums
from standlab.session import SMALL_ROWS, cut_lineage, small_side


def beta_moments(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Beta shapes by matching the mean and the n-denominator variance."""
    m, v = F.col("_m"), F.col("_v")
    common = F.try_divide(m * (1 - m), v) - 1
    return (df.groupBy(*by).agg(F.avg(col).alias("_m"), F.var_pop(col).alias("_v"))
            .withColumns({"alpha": m * common, "beta": (1 - m) * common}).drop("_m", "_v"))


def describe(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Minimum, maximum, median, mean, sd and sample-adjusted skewness and kurtosis; no row for a
    group, or a table, without values."""
    rows = df.filter(F.col(col).isNotNull())
    keys = by or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    n, g1, g2 = F.col("n"), F.col("_s"), F.col("_k")
    middle = exact_quantiles(rows, keys, col, {"median": 0.5}).select(*keys, "median")
    moments = rows.groupBy(*keys).agg(
        F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("sd"), F.skewness(col).alias("_s"), F.kurtosis(col).alias("_k"))
    return (match_nulls(moments, middle, keys)
            .withColumn("skewness", F.sqrt(n * (n - 1)) / (n - 2) * g1)
            .withColumn("kurtosis", (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3)
            .select(*(by or []), "n", "min", "max", "median", "mean", "sd", "skewness", "kurtosis"))


def _poisson_weights(seed: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) counts per (row, replicate) from a hash, the same on every retry."""
    with np.errstate(over="ignore"):
        z = seed.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(
            0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    u = (z >> np.uint64(11)) / float(1 << 53)
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(steps, u).astype(float)


def bootstrap_shape(df: DataFrame, col: str, key: str, replicates: int = 1000) -> DataFrame:
    """Skewness and kurtosis of bootstrap replicates.

    Every row carries a Poisson(1) weight per replicate, so a replicate is a weighted sum
    and rows are neither copied nor collected: the driver gets five sums per replicate.
    """
    rows = df.filter(F.col(col).isNotNull())
    centre = rows.agg(F.avg(col)).first()[0]
    seed = (F.shiftrightunsigned(F.xxhash64(key), 12)).cast("double")

    def kernel(x):
        w = _poisson_weights(x[:, 0], replicates)
        d = x[:, 1] - centre
        return (np.vander(d, 5, increasing=True).T @ w).ravel()

    s = partial_sums(rows.select(seed.alias("s"), F.col(col).cast("double").alias("v")),
                     kernel, 5 * replicates).reshape(5, replicates)
    n = s[0]
    m1, m2, m3, m4 = (s[i] / n for i in range(1, 5))
    var = m2 - m1 ** 2
    third = m3 - 3 * m1 * m2 + 2 * m1 ** 3
    fourth = m4 - 4 * m1 * m3 + 6 * m1 ** 2 * m2 - 3 * m1 ** 4
    skew = np.sqrt(n * (n - 1)) / (n - 2) * third / var ** 1.5
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * fourth / var ** 2 - 3 * (n - 1)) + 3
    rows = [(i + 1, float(a), float(a * a), float(b)) for i, (a, b) in enumerate(zip(skew, kurt))]
    return df.sparkSession.createDataFrame(rows, "replicate int, skewness double, skew_sq double, kurtosis double")


def kernel_density(df: DataFrame, by: list[str], col: str, points: int = 512,
                   continuous: bool = True) -> DataFrame:
    """Gaussian kernel density on an even grid reaching three bandwidths past the data.

    The bandwidth is the rule of thumb 0.9 * min(sd, IQR / 1.34) * n^-0.2.  Rows are
    spread linearly over the grid first, so smoothing sees at most ``points`` rows a group.
    """
    rows = df.filter(F.col(col).isNotNull())
    if continuous:
        q = exact_quantiles(rows, by, col, {"q25": 0.25, "q75": 0.75}).select(*by, "q25", "q75")
    else:
        p = F.percentile(col, F.array(F.lit(0.25), F.lit(0.75)))
        q = rows.groupBy(*by).agg(p.alias("_p")).select(
            *by, F.get("_p", F.lit(0)).alias("q25"), F.get("_p", F.lit(1)).alias("q75"))
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(col).alias("sd"),
                              F.min(col).alias("lo"), F.max(col).alias("hi")).join(q, by)
    spread = F.least("sd", F.nullif((F.col("q75") - F.col("q25")) / 1.34, F.lit(0.0)))
    s = (s.withColumn("bw", 0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
         .filter("bw > 0")
         .withColumn("lo", F.col("lo") - 3 * F.col("bw"))
         .withColumn("step", (F.col("hi") + 3 * F.col("bw") - F.col("lo")) / (points - 1))
         .select(*by, "n", "bw", "lo", "step"))
    s = small_side(s)
    at = (F.col(col) - F.col("lo")) / F.col("step")
    placed = (rows.select(*by, col).join(s, by)
              .select(*by, F.floor(at).alias("i"), (at - F.floor(at)).alias("f"))
              .select(*by, F.inline(F.array(F.struct(F.col("i").alias("i"), (1 - F.col("f")).alias("w")),
                                            F.struct((F.col("i") + 1).alias("i"), F.col("f").alias("w"))))))
    bins = placed.groupBy(*by, "i").agg(F.sum("w").alias("w")).join(s, by)

    def smooth(pdf):
        n, bw, lo, step = (pdf[c].iloc[0] for c in ("n", "bw", "lo", "step"))
        x = lo + step * np.arange(points)
        z = (x[:, None] - (lo + step * pdf["i"].to_numpy())[None, :]) / bw
        f = (np.exp(-z * z / 2) @ pdf["w"].to_numpy()) / (n * bw * math.sqrt(2 * math.pi))
        out = pd.DataFrame({c: pdf[c].iloc[0] for c in by}, index=range(points))
        return out.assign(point=np.arange(points), x=x, density=f, scaled=f * n)

    keys = "".join(f"`{c}` {t}, " for c, t in rows.select(*by).dtypes)
    return bins.groupBy(*by).applyInPandas(
        smooth, keys + "point int, x double, density double, scaled double")


def weibull_fit(df: DataFrame, by: list[str], col: str, steps: int = 200, tol: float = 1e-10) -> DataFrame:
    """Weibull shape and scale by maximum likelihood for every group at once.

    Rows collapse to value counts; a Newton step on the shape is one aggregate joined to
    the table of shapes.  Groups without spread or with too few values give no row.  The fit stops
    when no shape moves by the share ``tol`` or more; a group that has not settled after ``steps``
    steps gives no row and leaves the others' fits as they are.
    """
    z = F.log(col)
    rows = (df.filter(F.col(col) > 0).groupBy(*by, col)
            .agg(F.count(F.lit(1)).cast("double").alias("_n"))
            .withColumn("_z", z).persist())
    start = (rows.groupBy(*by).agg(
        F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.col("_z")) / F.sum("_n")).alias("_m"),
        F.sum(F.col("_n") * F.col("_z") * F.col("_z")).alias("_q"), F.max("_z").alias("_top"))
        .withColumn("_v", F.col("_q") / F.col("n") - F.col("_m") * F.col("_m"))
        .filter("n > 1 AND _v > 1e-12")
        .select(*by, "n", "_m", "_top", (1.2825 / F.sqrt("_v")).alias("shape")))
    state = cut_lineage(start)
    small = state.count() <= SMALL_ROWS
    # values are divided by the largest, which keeps the powers in range
    t = F.col("_z") - F.col("_top")
    e = F.col("_n") * F.exp(F.col("shape") * t)
    for i in range(steps):
        joined = rows.join(F.broadcast(state) if small else state, by)
        s = joined.groupBy(*by).agg(F.first("n").alias("n"), F.first("_m").alias("_m"),
                                    F.first("_top").alias("_top"), F.first("shape").alias("shape"), F.sum(e).alias("s0"),
                                    F.sum(e * t).alias("s1"), F.sum(e * t * t).alias("s2"))
        k, ratio = F.col("shape"), F.col("s1") / F.col("s0")
        slope = F.col("s2") / F.col("s0") - ratio * ratio + 1 / (k * k)
        step = F.greatest(k / 3, k - (ratio - (F.col("_m") - F.col("_top")) - 1 / k) / slope)
        state = s.select(*by, "n", "_m", "_top", step.alias("shape"), F.abs(step / k - 1).alias("_moved"))
        if i % 3 == 2 or i == steps - 1:
            state = cut_lineage(state)
            moved = state.agg(F.max("_moved")).first()[0] or 0.0
            if moved < tol:
                break
    state = state.filter(F.col("_moved") < tol)
    joined = rows.join(F.broadcast(state) if small else state, by)
    out = joined.groupBy(*by).agg(
        F.first("n").cast("bigint").alias("n"), F.first("shape").alias("shape"),
        F.first("_top").alias("_top"), F.sum(e).alias("_s"))
    k = F.col("shape")
    out = out.withColumn("scale", F.exp("_top") * F.pow(F.col("_s") / F.col("n"), 1 / k))
    out = cut_lineage(out.select(*by, "n", "shape", "scale"))
    rows.unpersist()
    return out


def histogram(df: DataFrame, by: list[str], col: str, width: float, factor: float = 1.0) -> DataFrame:
    """Counts per nearest class mark, scaled."""
    return (df.withColumn("mark", C.bin_round(col, width)).filter("mark IS NOT NULL")
            .groupBy(*by, "mark").agg((F.count(F.lit(1)) * F.lit(factor)).alias("scaled_count")))
