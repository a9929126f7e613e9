"""Treatment comparison from group counts, means and squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from standlab.functions.special import p_f, p_range, p_t
from standlab.operators.gram import dummies, global_moments, solve_ols
from standlab.operators.joins import match_nulls
from standlab.session import cut_lineage, literal_table, small_side


def cell_stats(df: DataFrame, y: str, cells: list[str]) -> DataFrame:
    return df.filter(F.col(y).isNotNull()).groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("ss"))


def anova_oneway(df: DataFrame, y: str, factor: str, by: list[str] | None = None,
                 p_value: bool = False) -> DataFrame:
    """Between and within squares, F and its tail probability, one row per group of ``by``."""
    by = by or []
    c = F.col
    cells = cut_lineage(cell_stats(df, y, [*by, factor]))  # one row a level, read twice
    centre = small_side(cells.groupBy(*by).agg((F.sum(c("n") * c("mean")) / F.sum("n")).alias("_m")))
    # level means beside their own mean: squares of differences do not cancel
    off = c("mean") - c("_m")
    s = match_nulls(cells, centre, by, "inner").groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("ss_within"),
        F.sum(c("n") * off * off).alias("ss_between"))
    out = (s.filter("k > 1 AND n > k")
           .withColumns({"df_between": c("k") - 1, "df_within": c("n") - c("k")})
           .withColumns({"ms_between": c("ss_between") / c("df_between"),
                         "ms_within": c("ss_within") / c("df_within")})
           .withColumn("f", F.try_divide("ms_between", "ms_within"))
           .drop("k", "n"))
    if p_value:
        out = out.withColumn("p", p_f("f", "df_between", "df_within"))
    return out


def anova_twoway(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Two factors with interaction, sequential squares; solved on the table of cells."""
    cells = cell_stats(df, y, [a, b]).orderBy(a, b).collect()  # factors: cells of declared treatments
    n = np.array([r["n"] for r in cells], float)
    m = np.array([r["mean"] for r in cells], float)
    within = sum(r["ss"] for r in cells)

    def design(name):
        values = [r[name] for r in cells]
        levels = sorted(set(values))
        return np.array([[v == lv for lv in levels] for v in values], float), len(levels)

    xa, ka = design(a)
    xb, kb = design(b)

    def rss(x):
        w = np.sqrt(n)[:, None]
        beta = np.linalg.lstsq(x * w, m * w[:, 0], rcond=None)[0]
        return float((n * (m - x @ beta) ** 2).sum())

    r0, r1, r2 = rss(np.ones((len(n), 1))), rss(xa), rss(np.hstack([xa, xb]))
    left = int(n.sum()) - len(cells)
    rows = [(a, ka - 1, r0 - r1), (b, kb - 1, r1 - r2),
            (f"{a}:{b}", len(cells) - ka - kb + 1, r2), ("residual", left, float(within))]
    ms = within / left
    table = literal_table(
        df.sparkSession, [(t, int(d), float(s), s / d if d else None,
                           s / d / ms if d and t != "residual" else None, left) for t, d, s in rows],
        "term string, df int, ss double, ms double, f double, df_error int")
    return table.withColumn("p", F.when(F.col("f").isNotNull(), p_f("f", F.col("df"), F.col("df_error"))))


def marginal_means(df: DataFrame, y: str, factor: list[str], over: list[str]) -> DataFrame:
    """Equal-weighted mean of cell means."""
    return (cell_stats(df, y, [*factor, *over]).groupBy(*factor)
            .agg(F.avg("mean").alias("emmean"), F.sum("n").alias("n")))


def all_pairs(df: DataFrame, y: str, factor: str, by: list[str] | None = None,
              p_value: bool = True) -> DataFrame:
    """Differences between all levels of a factor with the pooled error.

    Only the table of levels is paired.  ``q`` is the studentised range statistic;
    probabilities are adjusted over all pairs of the group.
    """
    by = by or []
    c = F.col
    cells = cell_stats(df, y, [*by, factor]).withColumn("_one", F.lit(1))
    keys = [*by, "_one"]
    pooled = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), (F.sum("n") - F.count(F.lit(1))).alias("df"),
                                      F.sum("ss").alias("_ss")).filter("df > 0")
    left = cells.select(*keys, c(factor).alias("level_a"), c("n").alias("_na"), c("mean").alias("_ma"))
    right = cells.select(*keys, c(factor).alias("level_b"), c("n").alias("_nb"), c("mean").alias("_mb"))
    pairs = left.join(right, keys).filter("level_a < level_b").join(pooled, keys)
    mse = c("_ss") / c("df")
    out = (pairs.select(*by, "level_a", "level_b", (c("_ma") - c("_mb")).alias("difference"),
                        F.sqrt(mse * (1 / c("_na") + 1 / c("_nb"))).alias("se"), "df", "k")
           .withColumn("t", F.try_divide("difference", "se"))
           .withColumn("q", F.abs("t") * F.sqrt(F.lit(2.0))))
    if p_value:
        m = c("k") * (c("k") - 1) / 2
        out = (out.withColumn("p_tukey", p_range("q", "k", "df"))
               .withColumn("p_bonferroni", F.least(F.lit(1.0), p_t("t", "df") * m)))
    return out.drop("k")


def model_contrasts(df: DataFrame, y: str, factor: str, levels: list[str],
                    others: dict[str, list[str]]) -> DataFrame:
    """All-pairs contrasts of one factor in an additive model, Bonferroni-adjusted."""
    wide, names = dummies(df, {factor: levels, **others})
    n, mean, cross = global_moments(wide, [*names, y])
    fit = solve_ols(n, mean, cross)
    at = {lv: (names.index(f"{factor}_{lv}") + 1 if i else None) for i, lv in enumerate(levels)}
    rows = []
    for i, a in enumerate(levels):
        for b in levels[i + 1:]:
            v = np.zeros(len(names) + 1)
            if at[a]:
                v[at[a]] += 1
            v[at[b]] -= 1
            rows.append((a, b, float(v @ fit["beta"]), float(np.sqrt(max(v @ fit["cov"] @ v, 0))),
                         int(fit["dof"])))
    table = literal_table(df.sparkSession, rows,
                          "level_a string, level_b string, difference double, se double, df int")
    return (table.withColumn("t", F.try_divide("difference", "se"))
            .withColumn("p_bonferroni", F.least(F.lit(1.0), p_t("t", "df") * len(rows))))


def welch(df: DataFrame, y: str, factor: str, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Unequal-variance two-sample statistic and its degrees of freedom."""
    x, c = F.col(factor), F.col
    out = df.groupBy(*(by or [])).agg(*[
        agg(F.when(x == lv, c(y))).alias(f"{name}_{side}")
        for side, lv in (("a", a), ("b", b))
        for name, agg in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    va, vb = c("v_a") / c("n_a"), c("v_b") / c("n_b")
    return out.select(*(by or []), ((c("m_a") - c("m_b")) / F.sqrt(va + vb)).alias("t"),
                      ((va + vb) * (va + vb) / (va * va / (c("n_a") - 1) + vb * vb / (c("n_b") - 1)))
                      .alias("df"))
