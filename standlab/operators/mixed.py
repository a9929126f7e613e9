"""Mixed models from per-group sufficient statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from standlab.functions.special import p_range, p_t
from standlab.operators import nls
from standlab.operators.gram import global_moments, linear_predictor, partial_sums
from standlab.session import cut_lineage, literal_table, small_side


@dataclass
class NestedFit:
    """Fixed terms, variances and group effects of a model with nested random intercepts."""

    terms: list[str]
    beta: np.ndarray
    se: np.ndarray
    cov: np.ndarray
    variances: list[float]      # one for each level, outermost first
    var_error: float
    theta: float                # error spread grows as weight_on^theta
    reml: float
    n: int
    levels: list[list[str]]
    tables: list[DataFrame]     # for each level its keys, n, effect
    groups: int                 # of the deepest level

    @property
    def var_group(self) -> float:
        return self.variances[0]

    @property
    def effects(self) -> DataFrame:
        return self.tables[0]

    @property
    def df(self) -> int:
        """Degrees of freedom of terms that vary within the deepest groups."""
        return self.n - self.groups - (len(self.beta) - 1)

    def fixed(self, spark) -> DataFrame:
        rows = [(t, float(b), float(s)) for t, b, s in zip(self.terms, self.beta, self.se)]
        names = ["group"] if len(self.levels) == 1 else [".".join(keys) for keys in self.levels]
        rows += [(f"var({name})", float(v), None) for name, v in zip(names, self.variances)]
        rows += [("var(residual)", self.var_error, None)]
        return literal_table(spark, rows, "term string, estimate double, se double")


class _Nested:
    """Sums of a nested model, and its restricted likelihood at any ratios of variances.

    Rows are reduced to one line of cross-products per deepest group.  Integrating out a group's
    intercept takes ``ratio / (1 + ratio n) s s'`` from its cross-products, and what is left adds up to
    the group above, whose intercept is integrated out the same way: level by level, no matrix
    larger than the fixed part is formed.
    """

    GROUP_ROWS = 250_000  # rows of a partition of gathered groups

    def __init__(self, df: DataFrame, y: str, xs: list[str], levels: list[list[str]], weight_on: str | None):
        for outer, inner in zip(levels, levels[1:]):
            if inner[:len(outer)] != outer:
                raise ValueError(f"level {inner} does not begin with the keys of level {outer}")
        self.levels, self.weight_on, self.spark = levels, weight_on, df.sparkSession
        cols = [*xs, y]
        rows = df.dropna(subset=[*cols, *levels[-1]])
        if weight_on:
            rows = rows.filter(F.col(weight_on) > 0)
        self.n, self.mean, _ = global_moments(rows, cols)
        self.k = len(cols) + 1
        self.pairs = [(i, j) for i in range(self.k) for j in range(i, self.k)]
        self.names = [f"c{q}" for q in range(len(self.pairs))]
        self.first = [q for q, (i, _) in enumerate(self.pairs) if i == 0]
        z = [F.lit(1.0)] + [F.col(c) - float(m) for c, m in zip(cols, self.mean)]
        self.rows = rows.select(*levels[-1], *[v.cast("double").alias(f"z{i}") for i, v in enumerate(z)],
                                (F.log(weight_on) if weight_on else F.lit(0.0)).alias("_l"))
        self.kept = None if weight_on else cut_lineage(self._lines([0.0]))
        if weight_on:
            self._gather()

    def _gather(self) -> None:
        """Rows of a deepest group brought together once, so that no pass shuffles them again.

        A group that would fill a partition alone stays dealt over all tasks: its rows meet by
        sums of every task, one for each exponent.
        """
        keys = self.levels[-1]
        named = dict(zip([f"_k{i}" for i in range(len(keys))], keys))
        hot = cut_lineage(self.rows.groupBy(*[F.col(c).alias(k) for k, c in named.items()]).count().filter(F.col("count") > self.GROUP_ROWS))
        rows, self.apart = self.rows, None
        if not hot.isEmpty():  # at most one for GROUP_ROWS rows
            same = [F.col(k) == F.col(c) for k, c in named.items()]
            rows = self.rows.join(hot, same, "left_anti")
            self.apart = cut_lineage(self.rows.join(hot, same, "left_semi"))
        self.together = rows.repartition(max(8, -(-int(self.n) // self.GROUP_ROWS)), *keys).persist()
        self.together.count()  # filled now: plans made earlier do not know how the rows are dealt

    def close(self) -> None:
        if self.weight_on:
            self.together.unpersist()

    def _lines(self, thetas: list[float]) -> DataFrame:
        """One line per deepest group and error exponent."""
        if not self.weight_on and thetas == [0.0] and getattr(self, "kept", None) is not None:
            return self.kept
        if not self.weight_on:
            return self._summed(self.rows, thetas)
        lines = self._summed(self.together, thetas)
        return lines if self.apart is None else lines.unionByName(self._summed(self.apart, thetas))

    def _summed(self, rows: DataFrame, thetas: list[float]) -> DataFrame:
        rows = rows.withColumn("theta", F.explode(F.array(*[F.lit(float(t)) for t in thetas])))
        w = F.exp(-2 * F.col("theta") * F.col("_l"))
        return rows.groupBy(*self.levels[-1], "theta").agg(
            *[F.sum(w * F.col(f"z{i}") * F.col(f"z{j}")).alias(c) for c, (i, j) in zip(self.names, self.pairs)],
            F.count(F.lit(1)).alias("n"), F.sum("_l").alias("logs"))

    def _above(self, state: DataFrame, ratio, level: int, extra: list[str]) -> DataFrame:
        """Groups of a level, their intercepts integrated out, added up to the level above."""
        shrink = ratio / (1 + ratio * F.col("c0"))
        s = [F.col(self.names[q]) for q in self.first]
        keys = self.levels[level - 1] if level else []
        left = state.select(*keys, *extra, "n", "logs", (F.col("det") + F.log1p(ratio * F.col("c0"))).alias("det"),
                            *[(F.col(c) - shrink * s[i] * s[j]).alias(c) for c, (i, j) in zip(self.names, self.pairs)])
        return left.groupBy(*keys, *extra).agg(*[F.sum(c).alias(c) for c in ["n", "logs", "det", *self.names]])

    def profile(self, points: np.ndarray) -> list[dict]:
        """Fits at the points (ratio of each level, exponent), all in one pass."""
        rows = [(i, *map(float, p)) for i, p in enumerate(points)]
        names = [f"r{level}" for level in range(len(self.levels))]
        grid = literal_table(self.spark, rows, "point int, " + ", ".join(f"{c} double" for c in names) + ", theta double")
        state = self._lines(sorted({float(p[-1]) for p in points})).join(F.broadcast(grid), "theta").withColumn("det", F.lit(0.0))
        for level in reversed(range(len(self.levels))):
            carried = ["point", "theta", *names[:level]]
            state = self._above(state, F.col(names[level]), level, carried)
        found = {r["point"]: r for r in state.collect()}
        return [self._solve(found[i], points[i]) for i in range(len(points))]

    def _solve(self, row, point) -> dict:
        full = np.zeros((self.k, self.k))
        full[np.triu_indices(self.k)] = [row[c] for c in self.names]
        full = full + np.triu(full, 1).T
        xx, xy, yy = full[:-1, :-1], full[:-1, -1], full[-1, -1]
        inverse = np.linalg.pinv(xx, hermitian=True)
        beta = inverse @ xy
        dof = self.n - (self.k - 1)
        rss = max(float(yy - beta @ xy), 1e-300)
        crit = -0.5 * (dof * (np.log(2 * np.pi * rss / dof) + 1) + row["det"] + np.linalg.slogdet(xx)[1]
                       + 2 * point[-1] * row["logs"])
        return {"crit": float(crit), "beta": beta, "s2": rss / dof, "inverse": inverse, "point": np.array(point, float)}

    def effects(self, fit: dict) -> list[DataFrame]:
        """Conditional effects of every level's groups: each group's residual sum less what the
        groups around it already explain, shrunken by its own ratio."""
        ratios, state, groups = fit["point"][:-1], self._lines([float(fit["point"][-1])]).withColumn("det", F.lit(0.0)), []
        for level in reversed(range(len(self.levels))):
            state = cut_lineage(state)
            groups.insert(0, state)
            state = self._above(state, F.lit(float(ratios[level])), level, [])
        residual = F.col(self.names[self.first[-1]]) - sum(
            (float(b) * F.col(self.names[q]) for b, q in zip(fit["beta"], self.first[:-1])), F.lit(0.0))
        tables, above = [], None
        for keys, ratio, table in zip(self.levels, ratios, groups):
            table = table.select(*keys, "n", "c0", residual.alias("_r"))
            if above is not None:
                table = table.join(above, self.levels[len(tables) - 1])
            else:
                table = table.withColumn("_total", F.lit(0.0))
            effect = float(ratio) * (F.col("_r") - F.col("c0") * F.col("_total")) / (1 + float(ratio) * F.col("c0"))
            table = cut_lineage(table.withColumn("effect", effect))
            tables.append(table.select(*keys, F.col("n").cast("long").alias("n"), "effect"))
            above = table.select(*keys, (F.col("_total") + F.col("effect")).alias("_total"))
        return tables


FLAT = -5.0  # log ratio under which a level's variance is tried at zero


def _highest(model: _Nested, theta: bool, tol: float, rounds: int) -> dict:
    """Highest restricted likelihood, by Newton steps on log ratios and the error exponent.

    Each round evaluates a stencil around the best point so far and the step it called for in one
    pass over the group lines.  A ratio that runs towards zero is set to zero where that is no worse.
    """
    size = len(model.levels)

    def ratios(x, zero):
        return np.concatenate([np.where(zero, 0.0, np.exp(np.clip(x[:size], -60, 60))), x[size:]])

    marks = np.array(np.meshgrid(*[[-7.0, -3.5, 0.0, 3.5]] * size)).reshape(size, -1).T
    marks = np.column_stack([marks, np.zeros(len(marks))])
    none = np.zeros(size, bool)
    fits = model.profile(np.array([ratios(x, none) for x in marks]))
    best = max(range(len(fits)), key=lambda i: fits[i]["crit"])
    x, fit, zero, width = marks[best], fits[best], none, 0.5
    for _ in range(rounds):
        free = [i for i in range(size) if not zero[i]] + ([size] if theta else [])
        if not free:
            return fit
        unit = np.eye(size + 1)[free] * width
        steps = [np.zeros(size + 1), *unit, *-unit, *[a + b for i, a in enumerate(unit) for b in unit[i + 1:]]]
        dropped = [i for i in free if i < size and x[i] < FLAT]
        fits = model.profile(np.array([ratios(x + d, zero) for d in steps] + [ratios(x, zero | (np.arange(size) == i)) for i in dropped]))
        f = [v["crit"] for v in fits]
        m = len(free)
        up, down = np.array(f[1:m + 1]), np.array(f[m + 1:2 * m + 1])
        at_zero = [(f[len(steps) + j], i, j) for j, i in enumerate(dropped) if up[free.index(i)] <= down[free.index(i)]]
        if at_zero and max(at_zero)[0] >= f[0]:
            _, i, j = max(at_zero)
            zero, fit = zero | (np.arange(size) == i), fits[len(steps) + j]
            continue
        slope = (up - down) / (2 * width)
        bend = np.diag((up - 2 * f[0] + down) / width ** 2)
        pair = iter(f[2 * m + 1:len(steps)])
        for i in range(m):
            for j in range(i + 1, m):
                bend[i, j] = bend[j, i] = (next(pair) - up[i] - up[j] + f[0]) / width ** 2
        values, vectors = np.linalg.eigh(bend)
        step = vectors @ ((vectors.T @ slope) / np.maximum(np.abs(values), 1e-8))
        step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-300))
        top = int(np.argmax(f[:len(steps)]))
        fit = fits[0]
        gain = float(slope @ step)  # a flat likelihood may move its point on without end
        if width <= 0.01 and (np.abs(step).max() < tol or abs(gain) < 1e-9 + 1e-12 * abs(f[0])):
            return fit
        move = np.zeros(size + 1)
        move[free] = step
        tries = model.profile(np.array([ratios(x + move * t, zero) for t in (1.0, 0.25)]))
        options = [(tries[0]["crit"], x + move), (tries[1]["crit"], x + move * 0.25), (f[top], x + steps[top])]
        crit, x = max(options, key=lambda o: o[0])
        width = max(0.005, min(width, float(np.abs(step).max())) if crit > f[0] else width / 4)
    raise RuntimeError(f"the variances did not settle in {rounds} rounds")


def nested_intercepts(df: DataFrame, y: str, xs: list[str], levels: list[list[str]], weight_on: str | None = None,
                      theta: float | None = None, points: list[list[float]] | None = None, tol: float = 1e-6,
                      rounds: int = 60) -> NestedFit:
    """Linear model with nested random intercepts by restricted likelihood.

    ``levels`` are key lists, outermost first, each beginning with the one before.  With
    ``weight_on`` the error's spread grows as a power of that column, whose exponent is fitted along
    unless ``theta`` gives it.  Instead of the highest likelihood, the best of ``points`` (a ratio of group to
    error variance for each level, then the exponent where there is one) can be asked for.  The fit
    settles to ``tol`` in every log ratio, or until a step would raise the log-likelihood by less than
    1e-9 (and 1e-12 of it), or raises.  Rows with a null in a used column are left out.
    """
    model = _Nested(df, y, xs, levels, weight_on)
    try:
        if points is not None:
            tail = [theta or 0.0] if len(points[0]) == len(levels) else []
            fit = max(model.profile(np.array([[*p, *tail] for p in points], float)), key=lambda f: f["crit"])
        elif weight_on and theta is not None:
            raise ValueError("a given exponent needs given points")
        else:
            fit = _highest(model, bool(weight_on), tol, rounds)
        tables = model.effects(fit)
    finally:
        model.close()
    k, ratios = model.k, fit["point"][:-1]
    # back from centred columns: only the intercept moves
    back = np.eye(k - 1)
    back[0, 1:] = -model.mean[:-1]
    original = back @ fit["beta"]
    original[0] += model.mean[-1]
    cov = back @ fit["inverse"] @ back.T * fit["s2"]
    return NestedFit(["(Intercept)", *xs], original, np.sqrt(np.diag(cov)), cov, [float(r * fit["s2"]) for r in ratios],
                     float(fit["s2"]), float(fit["point"][-1]), fit["crit"], int(model.n), levels, tables, tables[-1].count())


def random_intercept(df: DataFrame, y: str, xs: list[str], group: list[str],
                     ratios: list[float] | None = None) -> NestedFit:
    """Linear model with a random intercept per group: the one-level case of ``nested_intercepts``."""
    return nested_intercepts(df, y, xs, [group], points=None if ratios is None else [[r] for r in ratios])


def likelihood_profile(df: DataFrame, y: str, xs: list[str], levels: list[list[str]], points: list[list[float]],
                       weight_on: str | None = None) -> DataFrame:
    """Restricted log-likelihood at given ratios (and exponents), one row per point."""
    tail = [] if weight_on else [0.0]
    model = _Nested(df, y, xs, levels, weight_on)
    try:
        fits = model.profile(np.array([[*p, *tail] for p in points], float))
    finally:
        model.close()
    names = [f"ratio_{i}" for i in range(len(levels))]
    return literal_table(df.sparkSession, [(*map(float, f["point"]), f["crit"], f["s2"]) for f in fits],
                         ", ".join(f"{c} double" for c in [*names, "theta", "reml", "var_error"]))


def predict_nested(df: DataFrame, fit: NestedFit, out: str, level: int | None = None) -> DataFrame:
    """Fixed part plus the effects of the first ``level`` levels (all by default, 0 for none); a
    group without an effect, or a null key, counts as zero."""
    value = linear_predictor(fit.beta[0], dict(zip(fit.terms[1:], fit.beta[1:])))
    for i, (keys, table) in enumerate(list(zip(fit.levels, fit.tables))[:level]):
        df = df.join(small_side(table.select(*keys, F.col("effect").alias(f"_u{i}"))), keys, "left")
        value = value + F.coalesce(F.col(f"_u{i}"), F.lit(0.0))
    return df.withColumn(out, value).drop(*[f"_u{i}" for i in range(len(fit.levels))])


def _contrast_rows(fit: NestedFit, factor: str, levels: list[str], others: dict[str, list[str]], at: dict[str, float]) -> np.ndarray:
    """Design rows of a factor's levels: other factors equally weighted, numeric terms at given values."""
    rows = []
    for lv in levels:
        row = {"(Intercept)": 1.0, **{f"{factor}_{v}": float(v == lv) for v in levels[1:]}, **at}
        for name, values in others.items():
            row |= {f"{name}_{v}": 1 / len(values) for v in values[1:]}
        rows.append([row[t] for t in fit.terms])
    return np.array(rows)


def estimated_means(spark, fit: NestedFit, factor: str, levels: list[str], others: dict[str, list[str]] | None = None,
                    at: dict[str, float] | None = None) -> DataFrame:
    """Estimated marginal means of a factor whose dummies (``gram.dummies``) are terms of the fit.

    ``levels`` are the factor's declared levels; ``at`` gives each numeric term's value.
    """
    x = _contrast_rows(fit, factor, levels, others or {}, at or {})
    se = np.sqrt(np.einsum("ij,jk,ik->i", x, fit.cov, x))
    return literal_table(spark, [(lv, float(m), float(s), fit.df) for lv, m, s in zip(levels, x @ fit.beta, se)],
                         "level string, emmean double, se double, df int")


def estimated_pairs(spark, fit: NestedFit, factor: str, levels: list[str], p_value: bool = True) -> DataFrame:
    """Differences between all declared levels of a factor with the standard errors of the mixed model."""
    x = _contrast_rows(fit, factor, levels, {}, {t: 0.0 for t in fit.terms if t != "(Intercept)" and not t.startswith(f"{factor}_")})
    rows = []
    for i, a in enumerate(levels):
        for j in range(i + 1, len(levels)):
            d = x[i] - x[j]
            rows.append((a, levels[j], float(d @ fit.beta), float(np.sqrt(d @ fit.cov @ d)), fit.df))
    out = literal_table(spark, rows, "level_a string, level_b string, difference double, se double, df int")
    out = out.withColumn("t", F.try_divide("difference", "se")).withColumn("q", F.abs("t") * F.sqrt(F.lit(2.0)))
    if p_value:
        out = (out.withColumn("p_tukey", p_range("q", F.lit(len(levels)), "df"))
               .withColumn("p_bonferroni", F.least(F.lit(1.0), p_t("t", "df") * len(rows))))
    return out


def variance_components(df: DataFrame, y: str, group: str) -> DataFrame:
    """One-way variance components from mean squares, one pass to group lines."""
    lines = df.filter(F.col(y).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    nn, k = F.sum("n"), F.count(F.lit(1))
    grand = F.sum(F.col("n") * F.col("m")) / nn
    # between-group squares as n * variance of group means, each weighted by its size
    table = lines.agg(nn.alias("nn"), k.alias("k"), grand.alias("mean"),
                      F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"),
                      F.sum(F.col("n") * F.col("v")).alias("ssw"),
                      F.sum(F.col("n") * F.col("n")).alias("n2"))
    c = F.col
    return (table.withColumn("msb", (c("q") - c("nn") * c("mean") * c("mean")) / (c("k") - 1))
            .withColumn("msw", c("ssw") / (c("nn") - c("k")))
            .withColumn("n0", (c("nn") - c("n2") / c("nn")) / (c("k") - 1))
            .withColumn("var_group", F.greatest((c("msb") - c("msw")) / c("n0"), F.lit(0.0)))
            .select(c("k").alias("groups"), "mean", "msb", "msw", "var_group", c("msw").alias("var_error")))


def two_stage_height(df: DataFrame, by: list[str], height: str = "ht", dbh: str = "dbh") -> tuple[dict, DataFrame]:
    """Height curve 4.5 + exp(a + b/(d+1)) with group-varying a and b.

    An approximation to the joint likelihood: curves are fitted per group, then pulled
    towards the population pair by their sampling covariance.  Returns the population
    pair and a table of group estimates.
    """
    fits = nls.nls_by(df, height, "shifted_exponential", [dbh], by).persist()
    est = fits.select(F.get("estimate", F.lit(0)).alias("a"), F.get("estimate", F.lit(1)).alias("b"),
                      *[F.get("cov", F.lit(i)).alias(f"v{i}") for i in range(4)])
    s = est.agg(F.count(F.lit(1)).alias("k"), F.var_samp("a").alias("aa"), F.covar_samp("a", "b").alias("ab"),
                F.var_samp("b").alias("bb"), *[F.avg(f"v{i}").alias(f"v{i}") for i in range(4)]).first()
    spread = np.zeros((2, 2))
    if s["k"] > 1:
        spread = (np.array([[s["aa"], s["ab"]], [s["ab"], s["bb"]]])
                  - np.array([s[f"v{i}"] for i in range(4)]).reshape(2, 2))
        vals, vecs = np.linalg.eigh(spread)
        spread = vecs @ np.diag(np.maximum(vals, 0)) @ vecs.T

    def kernel(x):
        out = np.zeros(6)
        for row in x:
            w = np.linalg.pinv(row[2:].reshape(2, 2) + spread)
            out[:4] += w.ravel()
            out[4:] += w @ row[:2]
        return out

    sums = partial_sums(est, kernel, 6)
    mu = np.linalg.pinv(sums[:4].reshape(2, 2)) @ sums[4:]
    keys = ", ".join(f"`{c}` {t}" for c, t in fits.select(*by).dtypes)

    def shrink(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                v = np.array(r.cov).reshape(2, 2)
                pair = mu + spread @ np.linalg.pinv(spread + v) @ (np.array(r.estimate) - mu)
                out.append([*[getattr(r, c) for c in by], int(r.n), *r.estimate, *pair])
            yield pd.DataFrame(out, columns=[*by, "n", "a_fit", "b_fit", "a", "b"])

    table = cut_lineage(fits.mapInPandas(shrink, f"{keys}, n long, a_fit double, b_fit double, a double, b double"))
    fits.unpersist()
    return {"a": float(mu[0]), "b": float(mu[1])}, table


def predict_two_stage(df: DataFrame, population: dict, groups: DataFrame, by: list[str],
                      level: int = 1, dbh: str = "dbh") -> DataFrame:
    """``level=0`` scores with the population pair, ``level=1`` with the group's where known."""
    a, b = F.lit(population["a"]), F.lit(population["b"])
    if level:
        df = df.join(small_side(groups.select(*by, F.col("a").alias("_a"), F.col("b").alias("_b"))), by, "left")
        a, b = F.coalesce("_a", a), F.coalesce("_b", b)
    return df.withColumn("ht_fit", 4.5 + F.exp(a + b / (F.col(dbh) + 1))).drop("_a", "_b")


def nested_effects(df: DataFrame, y: str, x: str, levels: list[list[str]],
                   points: list[list[float]] | None = None) -> tuple[dict, list[DataFrame]]:
    """Straight line plus nested random intercepts: the fixed part and one effects table per level."""
    fit = nested_intercepts(df, y, [x], levels, points=points)
    fixed = {"intercept": float(fit.beta[0]), "slope": float(fit.beta[1]), "sigma2": fit.var_error,
             **{f"var_{i}": v for i, v in enumerate(fit.variances)}}
    return fixed, [table.withColumnRenamed("effect", f"b_{i}") for i, table in enumerate(fit.tables)]
