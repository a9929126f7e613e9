"""Non-linear least squares by damped Gauss-Newton on distributed cross-products.

Each step is one aggregate of J'J, J'r and the squared error.  A single fit keeps its
parameters on the driver; fits per group keep them in a table joined to the rows, one
job per step for all groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from standlab.session import SMALL_ROWS, cut_lineage, literal_table

@dataclass(frozen=True)
class Form:
    """A mean curve: parameter names, start values, and expressions for value and slopes."""
    params: tuple[str, ...]
    start: tuple[float, ...]
    curve: Callable[..., tuple[Column, list[Column]]]


def _chapman(p, d):
    e = F.exp(-p[1] * d)
    u = 1 - e
    top = F.pow(u, p[2])
    return 4.5 + p[0] * top, [top, p[0] * p[2] * F.pow(u, p[2] - 1) * d * e, p[0] * top * F.log(u)]


def _curtis(p, d):
    g = F.pow(d, p[2])
    e = F.exp(-p[1] * g)
    return 4.5 + p[0] * e, [e, -p[0] * g * e, -p[0] * p[1] * g * F.log(d) * e]


def _larsen(p, d):
    g = F.pow(d, p[2])
    m = F.exp(p[0] + p[1] * g)
    return 4.5 + m, [m, m * g, m * p[1] * g * F.log(d)]


def _weibull(p, d):
    g = F.pow(d, p[2])
    e = F.exp(-p[1] * g)
    return 4.5 + p[0] * (1 - e), [1 - e, p[0] * g * e, p[0] * p[1] * g * F.log(d) * e]


def _weibull_as_written(p, d):
    # the published script subtracts exp(b0 + b1 d^b2) from b0; kept beside the usual form
    g = F.pow(d, p[2])
    m = F.exp(p[0] + p[1] * g)
    return 4.5 + p[0] - m, [1 - m, -m * g, -m * p[1] * g * F.log(d)]


def _wykoff(p, d):
    m = F.exp(p[0] + p[1] / d)
    return 4.5 + m, [m, m / d]


def _power(p, d):
    g = F.pow(d, p[1])
    return 4.5 + p[0] * g, [g, p[0] * g * F.log(d)]


def _shifted(p, d):
    m = F.exp(p[0] + p[1] / (d + 1))
    return 4.5 + m, [m, m / (d + 1)]


def _base_logistic(p, h, d):
    g = F.pow(d, p[2])
    e = F.exp(p[0] + p[1] * g)
    k = -h * e / ((1 + e) * (1 + e))
    return h / (1 + e), [k, k * g, k * p[1] * g * F.log(d)]


def _base_logistic_short(p, h, d):
    g = F.pow(d, p[1])
    e = F.exp(p[0] * g)
    k = -h * e / ((1 + e) * (1 + e))
    return h / (1 + e), [k * g, k * p[0] * g * F.log(d)]


def _base_score(p, h, s):
    # the published expression divides by six after raising to the first power
    e = F.exp(-p[0] * s)
    return h / (1 + e) / 6, [h * s * e / ((1 + e) * (1 + e)) / 6]


def _crown_ratio(p, c):
    b = 1 + p[1] * c
    return 10 * p[0] / b, [10 / b, -10 * p[0] * c / (b * b)]


def _weibull_density(p, x):
    s, k = p[0], p[1]
    z = x / s
    zk = F.pow(z, k)
    f = (k / s) * F.pow(z, k - 1) * F.exp(-zk)
    return f, [f * (k / s) * (zk - 1), f * (1 / k + F.log(z) * (1 - zk))]


# fixed values: parameter names and default start values of each curve
FORMS = {
    "chapman_richards": Form(("b0", "b1", "b2"), (40.0, 0.3, 1.0), _chapman),
    "curtis": Form(("b0", "b1", "b2"), (60.0, 3.0, -0.5), _curtis),
    "larsen_hann": Form(("b0", "b1", "b2"), (4.0, -3.0, -0.5), _larsen),
    "weibull": Form(("b0", "b1", "b2"), (30.0, 0.3, 1.0), _weibull),
    "weibull_as_written": Form(("b0", "b1", "b2"), (28.0, -25.0, 0.05), _weibull_as_written),
    "wykoff": Form(("b0", "b1"), (3.5, -2.0), _wykoff),
    "power": Form(("b0", "b1"), (10.0, 0.35), _power),
    "shifted_exponential": Form(("a", "b"), (4.5, -6.0), _shifted),
    "base_logistic": Form(("b0", "b1", "b2"), (0.82, -0.8, -0.49), _base_logistic),
    "base_logistic_short": Form(("b1", "b2"), (-0.8, -0.49), _base_logistic_short),
    "base_score": Form(("a",), (1.0,), _base_score),
    "crown_ratio": Form(("a", "b"), (0.05, 0.005), _crown_ratio),
    "weibull_density": Form(("scale", "shape"), (7.0, 2.0), _weibull_density),
}
HEIGHT_FORMS = ["chapman_richards", "curtis", "larsen_hann", "weibull", "wykoff", "power"]


def _prepare(df: DataFrame, y: str, xs: list[str], by: list[str], collapse: bool,
             weight: str | None) -> DataFrame:
    """Rows of (keys, x.., weight, mean y, squared error inside the row).

    Curves see only the predictors, so rows sharing them collapse without loss.
    """
    rows = df.dropna(subset=[y, *xs])
    if not collapse:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        return rows.select(*by, *xs, w.alias("_w"), F.col(y).cast("double").alias("_y"),
                           F.lit(0.0).alias("_pe"), F.lit(1).cast("bigint").alias("_n"))
    n = F.count(F.lit(1))
    return rows.groupBy(*by, *xs).agg(n.cast("double").alias("_w"), F.avg(y).alias("_y"),
                                      (F.var_pop(y) * n).alias("_pe"), n.alias("_n"))


def _sums(form: Form, params: list[Column], xs: list[str], tag: str = "") -> list[Column]:
    value, slopes = form.curve(params, *[F.col(x) for x in xs])
    res, w, k = F.col("_y") - value, F.col("_w"), len(form.params)
    out = [F.sum(F.col("_pe") + w * res * res).alias(f"sse{tag}"), F.sum("_n").alias(f"n{tag}")]
    grad = [F.sum(w * res * s) for s in slopes]
    hess = [F.sum(w * slopes[i] * slopes[j]) for i in range(k) for j in range(i, k)]
    return out + [F.array(*grad).alias(f"g{tag}"), F.array(*hess).alias(f"h{tag}")]


class _Fit:
    """Levenberg-Marquardt bookkeeping of one fit; sees only sums."""

    def __init__(self, start, best=None, sse=np.inf, g=None, h=None, lam=1e-3, done=False, steps=0):
        self.cand = np.array(start, float)
        self.best = self.cand if best is None else np.array(best, float)
        self.sse, self.g, self.h, self.lam, self.done, self.steps = sse, g, h, lam, done, steps

    def advance(self, sse, g, h, tol):
        k = len(self.cand)
        full = np.zeros((k, k))
        ok = sse is not None and g is not None and np.isfinite(sse)
        if ok:
            full[np.triu_indices(k)] = np.array(h, float)
            full = full + np.triu(full, 1).T
            ok = bool(np.isfinite(full).all() and np.isfinite(np.array(g, float)).all())
        self.steps += 1
        if ok and sse <= self.sse:
            gain = self.sse - sse
            self.best, self.sse, self.g, self.h = self.cand, sse, np.array(g, float), full
            self.lam = max(self.lam / 10, 1e-12)
            self.done = gain <= tol * max(sse, 1e-300)
        else:
            self.lam *= 10
            self.done = self.lam > 1e12
        if self.g is None:
            self.done = True
            return
        damp = np.diag(np.maximum(np.diag(self.h), 1e-12)) * self.lam
        self.cand = self.best + np.linalg.pinv(self.h + damp) @ self.g

    def result(self, n):
        k = len(self.best)
        s2 = self.sse / (n - k) if n > k else np.nan
        cov = np.linalg.pinv(self.h) * s2 if self.h is not None else np.full((k, k), np.nan)
        aic = n * (np.log(2 * np.pi * self.sse / n) + 1) + 2 * (k + 1) if self.sse > 0 else np.nan
        return {"n": int(n), "estimate": self.best, "se": np.sqrt(np.diag(cov)), "cov": cov.ravel(),
                "sse": float(self.sse), "sigma2": float(s2), "aic": float(aic), "steps": self.steps}


RESULT = ("n long, estimate array<double>, se array<double>, cov array<double>, sse double, "
          "sigma2 double, aic double, steps int")


def fit_forms(df: DataFrame, y: str, forms: dict[str, tuple[str, list[str]]],
              starts: dict[str, tuple] | None = None, collapse: bool = True,
              weight: str | None = None, max_iter: int = 1000, tol: float = 1e-9) -> dict[str, dict]:
    """Fit several curves at once; every step reads the rows once for all of them.

    A curve stops when a step gains no more than the share ``tol`` of its squared error, or when no
    step of any length gains; curves that have not after ``max_iter`` steps raise.
    """
    xs = list(dict.fromkeys(x for _, cols in forms.values() for x in cols))
    rows = _prepare(df, y, xs, [], collapse, weight).withColumn("_all", F.lit(0)).persist()
    spark = df.sparkSession
    fits = {name: _Fit((starts or {}).get(name, FORMS[f].start)) for name, (f, _) in forms.items()}
    sizes: dict[str, int] = {}
    # parameters travel as one joined row, so every step runs the same expressions
    held = {name: [f"_p{i}_{j}" for j in range(len(fits[name].cand))] for i, name in enumerate(forms)}
    sums = {name: _sums(FORMS[f], [F.col(c) for c in held[name]], cols, f"_{i}")
            for i, (name, (f, cols)) in enumerate(forms.items())}
    at = {name: i for i, name in enumerate(forms)}
    try:
        for _ in range(max_iter):
            live = [name for name in forms if not fits[name].done]
            if not live:
                break
            values = [0, *[float(v) for name in live for v in fits[name].cand]]
            schema = ["_all int", *[f"{c} double" for name in live for c in held[name]]]
            now = literal_table(spark, [tuple(values)], ", ".join(schema))
            row = rows.join(F.broadcast(now), "_all").agg(*[c for name in live for c in sums[name]]).first()
            for name in live:
                i = at[name]
                sizes[name] = row[f"n_{i}"] or 0
                fits[name].advance(row[f"sse_{i}"], row[f"g_{i}"], row[f"h_{i}"], tol)
    finally:
        rows.unpersist()
    if open_ := [name for name in forms if not fits[name].done]:
        raise ArithmeticError(f"no convergence in {max_iter} steps: {', '.join(open_)}")
    return {name: {**fit.result(sizes[name]), "params": FORMS[forms[name][0]].params}
            for name, fit in fits.items() if fit.h is not None}


def nls(df: DataFrame, y: str, form: str, xs: list[str], start=None, **options) -> dict:
    """Fit one curve to all rows."""
    return fit_forms(df, y, {"fit": (form, xs)}, {"fit": start} if start else None, **options)["fit"]


def parameter_table(spark, fits: dict[str, dict]) -> DataFrame:
    """One row per curve and parameter, curves ranked by information criterion."""
    order = sorted(fits, key=lambda k: fits[k]["aic"])
    rows = [(name, order.index(name) + 1, term, float(e), float(s), f["sse"], f["aic"])
            for name, f in fits.items() for term, e, s in zip(f["params"], f["estimate"], f["se"])]
    return literal_table(spark, rows, "form string, rank int, term string, estimate double, "
                                      "se double, sse double, aic double")


def nls_by(df: DataFrame, y: str, form: str, xs: list[str], by: list[str], start=None,
           collapse: bool = True, weight: str | None = None, max_iter: int = 1000,
           tol: float = 1e-9) -> DataFrame:
    """Fit one curve per group; groups that fail, or have not settled after ``max_iter`` steps, give
    no row and leave the others' fits as they are.

    Without start values every group starts from the curve through all rows.
    """
    spec = FORMS[form]
    if start is None:
        start = nls(df, y, form, xs, collapse=collapse, weight=weight)["estimate"]
    start = [float(v) for v in start]
    rows = _prepare(df, y, xs, by, collapse, weight).persist()
    keys = ", ".join(f"`{c}` {t}" for c, t in rows.select(*by).dtypes)
    columns = [*by, "fit_n", "fit_cand", "fit_best", "fit_sse", "fit_g", "fit_h", "fit_lam", "fit_done", "fit_steps"]
    schema = (f"{keys}, fit_n long, fit_cand array<double>, fit_best array<double>, fit_sse double, "
              "fit_g array<double>, fit_h array<double>, fit_lam double, fit_done boolean, fit_steps int")
    k = len(start)

    def load(r):
        g = None if r.fit_g is None else np.array(r.fit_g, float)
        h = None if r.fit_h is None else np.array(r.fit_h, float).reshape(k, k)
        return _Fit(r.fit_cand, r.fit_best, r.fit_sse, g, h, r.fit_lam, r.fit_done, r.fit_steps)

    def update(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                fit = load(r)
                if not fit.done:
                    fit.advance(r.sse_new, r.g_new, r.h_new, tol)
                n = int(r.fit_n if pd.isna(r.n_new) else r.n_new)
                out.append([*[getattr(r, c) for c in by], n, fit.cand, fit.best, fit.sse, fit.g,
                            None if fit.h is None else fit.h.ravel(), fit.lam, fit.done, fit.steps])
            yield pd.DataFrame(out, columns=columns)

    arr = F.array(*[F.lit(v) for v in start])
    none = F.lit(None).cast("array<double>")
    state = rows.select(*by).distinct().select(
        *by, F.lit(0).cast("bigint").alias("fit_n"), arr.alias("fit_cand"), arr.alias("fit_best"),
        F.lit(float("inf")).alias("fit_sse"), none.alias("fit_g"), none.alias("fit_h"),
        F.lit(1e-3).alias("fit_lam"), F.lit(False).alias("fit_done"), F.lit(0).alias("fit_steps"))
    state = cut_lineage(state)
    small = state.count() <= SMALL_ROWS
    held = [F.get("fit_cand", F.lit(i)).alias(f"_p{i}") for i in range(k)]
    sums = _sums(spec, [F.col(f"_p{i}") for i in range(k)], xs, "_new")
    for _ in range(max_iter):
        now = state.filter("NOT fit_done").select(*by, *held)
        if now.isEmpty():
            break
        stats = rows.join(F.broadcast(now) if small else now, by).groupBy(*by).agg(*sums)
        state = cut_lineage(state.join(stats, by, "left").mapInPandas(update, schema))
    rows.unpersist()
    state = state.filter("fit_done")

    def finish(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.fit_h is None or r.fit_n <= k:
                    continue
                res = load(r).result(r.fit_n)
                out.append([*[getattr(r, c) for c in by], res["n"], res["estimate"], res["se"], res["cov"],
                            res["sse"], res["sigma2"], res["aic"], res["steps"]])
            yield pd.DataFrame(out, columns=[*by, "n", "estimate", "se", "cov", "sse", "sigma2", "aic", "steps"])

    return state.mapInPandas(finish, f"{keys}, {RESULT}")


def curve(form: str, estimate: str, xs: list[str]) -> Column:
    """Predicted value from an array column of estimates."""
    spec = FORMS[form]
    return spec.curve([F.get(estimate, F.lit(i)) for i in range(len(spec.params))],
                      *[F.col(x) for x in xs])[0]


def linearised(df: DataFrame, y: str, x: Column, by: list[str] | None = None,
               offset: float = 4.5) -> DataFrame:
    """Log-linear start: ln(y - offset) = a + b x for the two-parameter curves."""
    rows = df.filter(F.col(y) > offset).withColumns({"_ly": F.log(F.col(y) - offset), "_lx": x})
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.regr_intercept("_ly", "_lx").alias("a"),
        F.regr_slope("_ly", "_lx").alias("b"), F.regr_r2("_ly", "_lx").alias("r2"))
