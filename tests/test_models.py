"""Fits against numpy on small data with known answers."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from standlab.operators import subsets, counts, dist, gram, mixed, nls, smooth


def frame(spark, cols):
    names = list(cols)
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in row) for row in zip(*cols.values())]
    kinds = ["string" if isinstance(rows[0][i], str) else "double" for i in range(len(names))]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))).repartition(5)


def regression_data(k=7, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = {f"x{i}": rng.normal(1000 if i == 0 else 3, 1 + i, n) for i in range(k)}
    y = 5 + sum((i - 2) * 0.3 * v for i, v in enumerate(x.values())) + rng.normal(0, 2, n)
    return x, y


@pytest.mark.parametrize("k", [2, 7])
def test_ols_against_lstsq(spark, k):
    x, y = regression_data(k)
    design = np.column_stack([np.ones(len(y)), *x.values()])
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    s2 = rss[0] / (len(y) - k - 1)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(design.T @ design)))
    df = frame(spark, {**x, "y": y}).withColumn("g", F.lit("all"))
    for fit in (gram.ols(df, "y", list(x)).first(), gram.ols(df, "y", list(x), ["g"]).first()):
        assert fit["estimate"] == pytest.approx(beta.tolist(), rel=1e-6, abs=1e-6)
        assert fit["se"] == pytest.approx(se.tolist(), rel=1e-6)
        assert fit["sse"] == pytest.approx(rss[0])


def test_vif_and_subsets(spark):
    x, y = regression_data(6)
    x["x5"] = x["x4"] + 0.1 * x["x5"]
    df = frame(spark, {**x, "y": y})
    r = np.corrcoef(np.column_stack(list(x.values())), rowvar=False)
    assert list(gram.vif(df, list(x)).values()) == pytest.approx(np.diag(np.linalg.inv(r)).tolist(), rel=1e-6)
    from itertools import combinations
    m = np.column_stack(list(x.values()))
    for row in subsets.best_subsets(df, "y", list(x), 3).collect():
        best = min(np.linalg.lstsq(np.column_stack([np.ones(len(y)), m[:, c]]), y, rcond=None)[1][0]
                   for c in combinations(range(6), row["size"]))
        assert row["rss"] == pytest.approx(best, rel=1e-6)


def test_best_subsets_beyond_thirty_candidates(spark):
    rng = np.random.default_rng(3)
    x = {f"x{i}": rng.normal(size=200) for i in range(34)}
    # each alone explains little, so a forward search would begin with their shadow x0
    y = x["x5"] - x["x6"]
    x["x0"] = y + 0.5 * rng.normal(size=200)
    best = subsets.best_subsets(frame(spark, {**x, "y": y}), "y", list(x), 2).orderBy("size").collect()
    assert best[0]["terms"] == "x0" and best[1]["terms"] == "x5+x6"


def test_best_subsets_equal_full_enumeration(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 12))
    base[:, 6] = base[:, 0] + 0.1 * rng.normal(size=120)
    base[:, 7] = base[:, 1] - base[:, 2] + 0.05 * rng.normal(size=120)
    base[:, 11] = base[:, 3] + base[:, 4]  # depends on two others
    y = base[:, 0] - base[:, 1] + 0.7 * base[:, 3] + rng.normal(size=120)
    df = frame(spark, {**{f"x{i}": base[:, i] for i in range(12)}, "flat": np.ones(120), "y": y})
    got = {r["size"]: r for r in subsets.best_subsets(df, "y", [f"x{i}" for i in range(12)] + ["flat"], 6, budget=20).collect()}
    x, z = base - base.mean(axis=0), y - y.mean()
    for size in range(1, 7):
        rss = {c: np.linalg.lstsq(x[:, c], z, rcond=None) for c in combinations(range(12), size)}
        least = min(float(((z - x[:, c] @ v[0]) ** 2).sum()) for c, v in rss.items())
        assert got[size]["rss"] == pytest.approx(least, rel=1e-8)
        chosen = [int(t[1:]) for t in got[size]["terms"].split("+")]
        assert float(((z - x[:, chosen] @ np.linalg.lstsq(x[:, chosen], z, rcond=None)[0]) ** 2).sum()) == pytest.approx(least, rel=1e-8)


def test_best_subsets_of_48_terms(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 48)) @ (np.eye(48) + 0.1 * rng.normal(size=(48, 48)))
    true = [3, 11, 19, 27, 40]
    y = x[:, true] @ np.array([1.0, -1.0, 0.8, 0.6, 0.5]) + rng.normal(size=400)
    got = {r["size"]: r["terms"] for r in subsets.best_subsets(
        frame(spark, {**{f"x{i}": x[:, i] for i in range(48)}, "y": y}), "y", [f"x{i}" for i in range(48)], 8).collect()}
    assert sorted(got) == list(range(1, 9)) and got[5] == "+".join(f"x{i}" for i in true)
    search = subsets.Search(np.corrcoef(np.column_stack([x, y]).T), 8, {})
    search.start()
    found = subsets.Search(np.corrcoef(np.column_stack([x, y]).T), 8, search.best)
    for size, terms in got.items():
        chosen = [int(t[1:]) for t in terms.split("+")]
        assert found.residual(chosen) <= search.best[size][0] + 1e-9


def test_factor_columns(spark):
    df = frame(spark, {"g": ["a", "b", "c"] * 4, "x": np.arange(12.0), "y": np.tile([1.0, 3.0, 7.0], 4)})
    wide, names = gram.dummies(df, {"g": ["a", "b", "c"]}, [("x", "g")])
    assert names == ["g_b", "g_c", "x_x_g_b", "x_x_g_c"]
    fit = gram.ols(wide, "y", names[:2]).first()
    assert fit["estimate"] == pytest.approx([1.0, 2.0, 6.0])


CURVES = {
    "chapman_richards": ((27.0, 0.2, 1.3), lambda p, d: 4.5 + p[0] * (1 - np.exp(-p[1] * d)) ** p[2]),
    "curtis": ((50.0, 3.0, -0.6), lambda p, d: 4.5 + p[0] * np.exp(-p[1] * d ** p[2])),
    "larsen_hann": ((3.9, -2.9, -0.6), lambda p, d: 4.5 + np.exp(p[0] + p[1] * d ** p[2])),
    "weibull": ((27.0, 0.13, 1.2), lambda p, d: 4.5 + p[0] * (1 - np.exp(-p[1] * d ** p[2]))),
    "wykoff": ((3.5, -3.3), lambda p, d: 4.5 + np.exp(p[0] + p[1] / d)),
    "power": ((5.2, 0.65), lambda p, d: 4.5 + p[0] * d ** p[1]),
}


def test_curves_recover_their_parameters(spark):
    d = np.tile(np.arange(1, 41) / 4, 5)
    for name, (p, f) in CURVES.items():
        fit = nls.nls(frame(spark, {"d": d, "y": f(p, d)}), "y", name, ["d"])
        assert fit["estimate"].tolist() == pytest.approx(list(p), rel=1e-4), name


def test_curve_per_group_equals_separate_fits(spark):
    rng = np.random.default_rng(5)
    d = np.tile(np.arange(1, 31) / 3, 4)
    g = np.repeat(["a", "b"], 60)
    y = np.where(g == "a", CURVES["wykoff"][1]((3.4, -3.0), d), CURVES["wykoff"][1]((3.7, -4.0), d)) + rng.normal(0, 0.5, 120)
    df = frame(spark, {"g": g.tolist(), "d": d, "y": y})
    for r in nls.nls_by(df, "y", "wykoff", ["d"], ["g"]).collect():
        one = nls.nls(df.filter(F.col("g") == r["g"]), "y", "wykoff", ["d"])
        assert r["estimate"] == pytest.approx(one["estimate"].tolist(), rel=1e-5)
        assert r["sse"] == pytest.approx(one["sse"], rel=1e-8)


def test_random_intercept_against_dense_likelihood(spark):
    rng = np.random.default_rng(2)
    sizes = [3, 5, 8, 12, 4, 9]
    g = np.repeat(np.arange(6), sizes)
    x = rng.normal(10, 2, len(g))
    y = 3 + 0.7 * x + rng.normal(0, 2, 6)[g] + rng.normal(0, 1, len(g))
    df = frame(spark, {"g": [f"g{v}" for v in g], "x": x, "y": y})
    fit = mixed.random_intercept(df, "y", ["x"], ["g"])

    design, z = np.column_stack([np.ones(len(g)), x]), np.eye(6)[g]

    def dense(lam):
        v = np.eye(len(g)) + lam * z @ z.T
        w = np.linalg.inv(v)
        xx = design.T @ w @ design
        beta = np.linalg.solve(xx, design.T @ w @ y)
        r = y - design @ beta
        s2 = r @ w @ r / (len(g) - 2)
        crit = -0.5 * ((len(g) - 2) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1])
        return crit, beta, s2, lam * z.T @ w @ r

    lam = fit.var_group / fit.var_error
    crit, beta, s2, u = dense(lam)
    assert fit.beta == pytest.approx(beta.tolist(), rel=1e-6)
    assert fit.var_error == pytest.approx(s2, rel=1e-6)
    assert all(dense(lam * f)[0] <= crit + 1e-6 for f in (0.9, 0.99, 1.01, 1.1))
    got = {r["g"]: r["effect"] for r in fit.effects.collect()}
    assert [got[f"g{i}"] for i in range(6)] == pytest.approx(u.tolist(), rel=1e-5, abs=1e-8)


def test_nested_effects_follow_the_truth(spark):
    rng = np.random.default_rng(4)
    s, b, p = np.meshgrid(range(4), range(5), range(6), indexing="ij")
    s, b, p = (np.repeat(v.ravel(), 10) for v in (s, b, p))
    us, ub = rng.normal(0, 1.0, 4), rng.normal(0, 0.5, (4, 5))
    x = rng.normal(2, 1, len(s))
    y = 1 + 0.8 * x + us[s] + ub[s, b] + rng.normal(0, 0.2, len(s))
    df = frame(spark, {"s": [f"s{v}" for v in s], "b": [f"b{v}" for v in b], "p": [f"p{v}" for v in p], "x": x, "y": y})
    fixed, tables = mixed.nested_effects(df, "y", "x", [["s"], ["s", "b"], ["s", "b", "p"]])
    assert fixed["slope"] == pytest.approx(0.8, abs=0.02)
    assert fixed["sigma2"] == pytest.approx(0.04, abs=0.01)
    top = {r["s"]: r["b_0"] for r in tables[0].collect()}
    mid = {(r["s"], r["b"]): r["b_1"] for r in tables[1].collect()}
    total = [top[f"s{i}"] + mid[f"s{i}", f"b{j}"] + fixed["intercept"] for i in range(4) for j in range(5)]
    assert total == pytest.approx([1 + us[i] + ub[i, j] for i in range(4) for j in range(5)], abs=0.15)


def _dense_reml(y, design, zs, ratios, w=None):
    """Restricted likelihood, coefficients, error variance and effects on the whole covariance matrix."""
    w = np.ones(len(y)) if w is None else w
    v = np.diag(1 / w) + sum(r * z @ z.T for r, z in zip(ratios, zs))
    inv = np.linalg.inv(v)
    xx = design.T @ inv @ design
    beta = np.linalg.solve(xx, design.T @ inv @ y)
    r = y - design @ beta
    dof = len(y) - design.shape[1]
    s2 = r @ inv @ r / dof
    crit = -0.5 * (dof * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1])
    return crit, beta, s2, [q * z.T @ inv @ r for q, z in zip(ratios, zs)]


@pytest.mark.parametrize("weighted", [False, True])
def test_nested_intercepts_against_dense_likelihood(spark, weighted):
    rng = np.random.default_rng(9)
    s, b, p = np.meshgrid(range(4), range(4), range(3), indexing="ij")
    copies = rng.integers(2, 6, 48)
    s, b, p = (np.repeat(v.ravel(), copies) for v in (s, b, p))
    d = rng.uniform(1, 6, len(s))
    x = np.log(d)
    y = (2 + 0.5 * x + rng.normal(0, 1, 4)[s] + rng.normal(0, 0.7, (4, 4))[s, b] + rng.normal(0, 0.5, (4, 4, 3))[s, b, p]
         + rng.normal(0, 0.4, len(s)) * (d ** 0.6 if weighted else 1))
    df = frame(spark, {"s": [f"s{v}" for v in s], "b": [f"b{v}" for v in b], "p": [f"p{v}" for v in p], "x": x, "y": y, "d": d})
    levels = [["s"], ["s", "b"], ["s", "b", "p"]]
    fit = mixed.nested_intercepts(df, "y", ["x"], levels, weight_on="d" if weighted else None)
    zs = [np.eye(4)[s], np.eye(16)[s * 4 + b], np.eye(48)[(s * 4 + b) * 3 + p]]
    design = np.column_stack([np.ones(len(y)), x])
    ratios = [v / fit.var_error for v in fit.variances]

    def at(ratios, theta):
        crit, *rest = _dense_reml(y, design, zs, ratios, d ** (-2 * theta))
        return crit, *rest

    crit, beta, s2, effects = at(ratios, fit.theta)
    assert fit.reml == pytest.approx(crit, rel=1e-9) and (fit.theta != 0) == weighted
    assert fit.beta == pytest.approx(beta.tolist(), rel=1e-7) and fit.var_error == pytest.approx(s2, rel=1e-7)
    for i in range(3):
        for f in (0.98, 1.02):
            assert at([r * (f if i == j else 1) for j, r in enumerate(ratios)], fit.theta)[0] <= crit + 1e-9
    if weighted:
        assert max(at(ratios, fit.theta + h)[0] for h in (-0.01, 0.01)) <= crit
    for i, (table, want) in enumerate(zip(fit.tables, effects)):
        got = {tuple(r[k] for k in levels[i]): r["effect"] for r in table.collect()}
        names = sorted({(f"s{u}", f"b{v}", f"p{w}")[:i + 1] for u, v, w in zip(s, b, p)})
        assert [got[k] for k in names] == pytest.approx(want.tolist(), rel=1e-5, abs=1e-8)
    scored = mixed.predict_nested(df, fit, "fitted").orderBy("x").collect()
    whole = design @ beta + sum(z @ u for z, u in zip(zs, effects))
    assert [r["fitted"] for r in scored] == pytest.approx(whole[np.argsort(x)].tolist(), rel=1e-6)


def test_a_level_without_variance_gets_none(spark):
    rng = np.random.default_rng(1)
    g = np.repeat(np.arange(8), 6)
    y = rng.normal(0, 1, 48)
    y = y - np.array([y[g == i].mean() for i in range(8)])[g]  # all groups alike
    fit = mixed.random_intercept(frame(spark, {"g": [str(v) for v in g], "y": y, "x": np.tile(np.arange(6.0), 8)}), "y", ["x"], ["g"])
    assert fit.var_group == 0 and all(r["effect"] == 0 for r in fit.effects.collect())
    with pytest.raises(ValueError):
        mixed.nested_intercepts(fit.effects, "effect", [], [["g"], ["n"]])


def test_weighted_group_lines_are_shuffled_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", 0 if i < 150 else i % 9, *map(float, rng.uniform(1, 5, 3))) for i in range(240)]
    df = spark.createDataFrame(rows, "g string, p int, x double, d double, y double")

    def model():
        return mixed._Nested(df, "y", ["x"], [["g"], ["g", "p"]], "d")

    def lines(of):
        return {(r["g"], r["p"], r["theta"], c): r[c] for r in of._lines([0.0, 0.5]).collect() for c in ["n", "logs", *of.names]}

    whole = model()
    plan = whole._lines([0.0, 0.5])._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and "Exchange" not in plan[:plan.index("InMemoryTableScan")]
    monkeypatch.setattr(mixed._Nested, "GROUP_ROWS", 40)  # groups of plot 0 stay dealt over all tasks
    dealt = model()
    assert whole.apart is None and dealt.apart.count() >= 150 and dealt.together.count() + dealt.apart.count() == 240
    assert lines(dealt) == pytest.approx(lines(whole), abs=1e-9)
    whole.close()
    dealt.close()



def test_block_model_means_and_pairs_against_dense_solution(spark):
    rng = np.random.default_rng(12)
    block, code = (v.ravel() for v in np.meshgrid(range(6), range(3), indexing="ij"))
    keep = rng.uniform(size=18) > 0.15  # unbalanced
    block, code = block[keep], code[keep]
    y = 5 + np.array([0, 1, 3])[code] + rng.normal(0, 2, 6)[block] + rng.normal(0, 0.5, len(block))
    df, names = gram.dummies(frame(spark, {"block": [f"b{v}" for v in block], "code": [("P", "Q", "R")[v] for v in code], "y": y}),
                             {"code": ["P", "Q", "R"]})
    fit = mixed.random_intercept(df, "y", names, ["block"])
    design = np.column_stack([np.ones(len(y)), code == 1, code == 2]).astype(float)
    z = np.eye(6)[block]
    crit, beta, s2, _ = _dense_reml(y, design, [z], [fit.var_group / fit.var_error])
    inv = np.linalg.inv(np.eye(len(y)) + fit.var_group / fit.var_error * z @ z.T)
    cov = np.linalg.inv(design.T @ inv @ design) * s2
    means = {r["level"]: r for r in mixed.estimated_means(spark, fit, "code", ["P", "Q", "R"]).collect()}
    assert means["R"]["emmean"] == pytest.approx(beta[0] + beta[2], rel=1e-7)
    assert means["R"]["se"] == pytest.approx(math.sqrt(cov[0, 0] + 2 * cov[0, 2] + cov[2, 2]), rel=1e-7)
    pairs = {(r["level_a"], r["level_b"]): r for r in mixed.estimated_pairs(spark, fit, "code", ["P", "Q", "R"]).collect()}
    assert pairs["Q", "R"]["difference"] == pytest.approx(beta[1] - beta[2], rel=1e-7)
    assert pairs["Q", "R"]["se"] == pytest.approx(math.sqrt(cov[1, 1] + cov[2, 2] - 2 * cov[1, 2]), rel=1e-7)
    assert pairs["Q", "R"]["df"] == len(y) - 6 - 2 and 0 < pairs["P", "R"]["p_tukey"] < pairs["P", "R"]["p_bonferroni"] < 0.1


def test_two_stage_height_pulls_small_groups(spark):
    rng = np.random.default_rng(6)
    d = rng.uniform(1, 10, 430)
    g = ["a"] * 200 + ["b"] * 200 + ["c"] * 30
    a = np.array([{"a": 3.5, "b": 3.7, "c": 3.6}[v] for v in g])
    y = 4.5 + np.exp(a - 5 / (d + 1)) + rng.normal(0, 1, 430)
    population, table = mixed.two_stage_height(frame(spark, {"g": g, "dbh": d, "ht": y}), ["g"])
    rows = {r["g"]: r for r in table.collect()}
    assert population["a"] == pytest.approx(3.6, abs=0.1)
    for r in rows.values():
        low, high = sorted([r["a_fit"], population["a"]])
        assert low - 0.05 <= r["a"] <= high + 0.05


def test_zero_inflated_counts_are_recovered(spark):
    rng = np.random.default_rng(8)
    n = 6000
    x, z = rng.normal(50, 10, n), rng.normal(0, 1, n)
    mu, theta = np.exp(0.5 + 0.02 * x), 3.0
    y = rng.poisson(rng.gamma(theta, mu / theta))
    y = np.where(rng.uniform(size=n) < 1 / (1 + np.exp(-(-0.5 + 0.8 * z))), 0, y).astype(float)
    df = frame(spark, {"x": x, "z": z, "y": y})
    fit = counts.zinb(df, "y", ["x"], ["z"])
    assert fit["count"]["x"] == pytest.approx(0.02, abs=0.004)
    assert fit["count"]["(Intercept)"] == pytest.approx(0.5, abs=0.2)
    assert fit["zero"]["z"] == pytest.approx(0.8, abs=0.15)
    assert fit["zero"]["(Intercept)"] == pytest.approx(-0.5, abs=0.15)
    assert fit["theta"] == pytest.approx(3.0, rel=0.2)
    mean = df.agg(F.avg(counts.zinb_response(fit))).first()[0]
    assert mean == pytest.approx(y.mean(), rel=0.03)


def weibull_ml(d):
    low, high = 1e-3, 1e3
    for _ in range(200):
        k = math.sqrt(low * high)
        t = (d / d.max()) ** k
        if (t * np.log(d)).sum() / t.sum() - 1 / k - np.log(d).mean() > 0:
            high = k
        else:
            low = k
    return k, (d ** k).mean() ** (1 / k)


def test_weibull_against_bisection(spark):
    rng = np.random.default_rng(9)
    data = {"a": np.round(rng.weibull(1.7, 400) * 8, 1) + 0.1, "b": rng.weibull(6, 50) * 30, "c": np.array([5.0, 5.0])}
    df = frame(spark, {"g": [g for g, v in data.items() for _ in v], "d": np.concatenate(list(data.values()))})
    rows = {r["g"]: r for r in dist.weibull_fit(df, ["g"], "d").collect()}
    assert set(rows) == {"a", "b"}
    for g in rows:
        k, lam = weibull_ml(data[g])
        assert rows[g]["shape"] == pytest.approx(k, rel=1e-6) and rows[g]["scale"] == pytest.approx(lam, rel=1e-6)


def test_groups_that_have_not_settled_give_no_row(spark):
    rng = np.random.default_rng(3)
    d = rng.weibull(1.7, 200) * 8 + 0.1
    df = frame(spark, {"g": ["a"] * 200, "d": d, "y": CURVES["wykoff"][1]((3.4, -1.0), d) + rng.normal(0, 0.5, 200)})
    assert dist.weibull_fit(df, ["g"], "d", steps=2).count() == 0
    with pytest.raises(ArithmeticError):
        nls.nls(df, "y", "wykoff", ["d"], max_iter=2)
    assert nls.nls_by(df, "y", "wykoff", ["d"], ["g"], start=[1.0, -9.0], max_iter=2).count() == 0
    assert nls.nls_by(df, "y", "wykoff", ["d"], ["g"], start=[1.0, -9.0]).count() == 1


def test_variance_power_and_boxcox(spark):
    rng = np.random.default_rng(10)
    d = rng.uniform(1, 12, 4000)
    df = frame(spark, {"d": d, "x": d, "y": 2 + 0.5 * d + rng.normal(0, 1, 4000) * 0.1 * d ** 0.8})
    fits = gram.variance_power(df, "y", "x", "d", [i / 10 for i in range(16)]).collect()
    best = max(fits, key=lambda r: r["loglik"])
    assert best["theta"] == pytest.approx(0.8, abs=0.11) and best["slope"] == pytest.approx(0.5, abs=0.02)
    logs = frame(spark, {"v": np.exp(rng.normal(2, 0.4, 3000))})
    assert abs(gram.boxcox_best(logs, "v").first()[0]) < 0.15


def test_bootstrap_is_deterministic_and_centred(spark):
    rng = np.random.default_rng(11)
    v = rng.gamma(3, 1, 400)
    df = frame(spark, {"k": [f"k{i}" for i in range(400)], "v": v})
    a = sorted(map(tuple, dist.bootstrap_shape(df, "v", "k", 300).collect()))
    b = sorted(map(tuple, dist.bootstrap_shape(df.repartition(2), "v", "k", 300).collect()))
    assert np.array(a) == pytest.approx(np.array(b), rel=1e-8)
    skew = dist.describe(df, "v").first()["skewness"]
    assert np.mean([r[1] for r in a]) == pytest.approx(skew, abs=0.15)


def test_kernel_density_against_direct_sum(spark):
    rng = np.random.default_rng(12)
    v = np.round(rng.normal(8, 2, 500), 1)
    rows = dist.kernel_density(frame(spark, {"g": ["a"] * 500, "v": v}), ["g"], "v", 512).orderBy("point").collect()
    q = np.quantile(v, [0.25, 0.75])
    bw = 0.9 * min(v.std(ddof=1), (q[1] - q[0]) / 1.34) * 500 ** -0.2
    x = np.array([r["x"] for r in rows])
    direct = np.exp(-((x[:, None] - v) / bw) ** 2 / 2).sum(axis=1) / (500 * bw * math.sqrt(2 * math.pi))
    assert np.array([r["density"] for r in rows]) == pytest.approx(direct, abs=2e-5)
    assert np.trapezoid(direct, x) == pytest.approx(1, abs=0.01)


def test_smoothers(spark):
    x = np.arange(40) / 39
    df = frame(spark, {"g": ["a"] * 40, "x": x, "y": 3 + 2 * x + x ** 2})
    fit = smooth.local_regression(df, ["g"], "x", "y").collect()
    assert [r["smooth"] for r in fit] == pytest.approx([3 + 2 * r["x"] + r["x"] ** 2 for r in fit])
    line = frame(spark, {"g": ["a"] * 40, "x": x, "y": 5 - 8 * x})
    out = smooth.smooth_profile(line, ["g"], "x", "y").collect()
    assert all(r["smooth"] >= 0 for r in out)
    assert [r["smooth"] for r in out] == pytest.approx([max(5 - 8 * r["x"], 0) for r in out], abs=1e-6)


def test_banded_smoother_and_many_points(spark):
    from standlab.operators import smooth

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 60):
        v, a = rng.normal(size=n), np.eye(n)
        if n > 2:
            d = np.diff(np.eye(n), 2, axis=0)
            a = a + 10 * d.T @ d
        assert smooth._whittaker(v, 10.0) == pytest.approx(np.linalg.solve(a, v))
    rows = [("g", float(i), float(i % 7)) for i in range(30_000)]
    out = smooth.smooth_profile(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y")
    assert out.count() == 30_000


def test_dispersion_grid_takes_one_gamma_table_a_trial(monkeypatch):
    rng = np.random.default_rng(2)
    v, mu, w = rng.integers(0, 6, 500) * 5.0, np.exp(rng.normal(1, 0.5, 500)), rng.uniform(0, 1, 500)
    grid = [0.01, 0.7, 12.0, 3e4]
    want = [sum(a * (math.lgamma(y + th) - math.lgamma(th) - math.lgamma(y + 1) + th * math.log(th / (th + m))
                     + y * math.log(m / (th + m))) for y, m, a in zip(v, mu, w)) for th in grid]
    values, at = np.unique(v, return_inverse=True)
    monkeypatch.setattr(np, "unique", None)  # distinct counts are found once a batch, not once a trial
    assert counts._dispersion(v, values, at, mu, np.log(mu), w, grid) == pytest.approx(want, rel=1e-9)
    one = counts._log_nb(v, values, at, mu, np.log(mu), 0.7)
    assert w @ one == pytest.approx(want[1], rel=1e-9)
