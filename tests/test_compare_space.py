"""Tail probabilities, treatment tests, terrain, crown profile and plot centres."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from standlab.functions import special
from standlab.operators import compare, crown, spatial, suitability, terrain, yields
from standlab.operators.terrain import FLOW


def test_tail_probabilities_against_tables():
    assert special.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert special.f_tail(3.1059, 4, 12) == pytest.approx(0.0572, abs=2e-4)
    assert special.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_tail(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)
    for q, k, df in [(3.877, 3, 10), (4.327, 4, 10), (3.578, 3, 20), (6.085, 2, 2), (4.735, 10, 40)]:
        p = special.studentised_range_tail(q, k, df)
        assert 0.045 < p < 0.062, (q, k, df, p)
    assert special.studentised_range_tail(3.0, 2, 15) == pytest.approx(special.t_tail(3.0 / math.sqrt(2), 15), abs=1e-6)


def groups(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(g, b, float(rng.normal(m, 1))) for g, m in zip("abc", (5, 6, 8)) for b in ("u", "v") for _ in range(6)]
    return rows, spark.createDataFrame(rows, "g string, b string, y double").repartition(3)


def test_anova_and_pairs(spark):
    rows, df = groups(spark)
    y = {g: np.array([v for k, _, v in rows if k == g]) for g in "abc"}
    grand = np.mean([v for _, _, v in rows])
    ssb = sum(len(v) * (v.mean() - grand) ** 2 for v in y.values())
    ssw = sum(((v - v.mean()) ** 2).sum() for v in y.values())
    r = compare.anova_oneway(df, "y", "g", p_value=True).first()
    assert r["f"] == pytest.approx(ssb / 2 / (ssw / 33))
    assert 0 <= r["p"] <= 1
    pairs = {(p["level_a"], p["level_b"]): p for p in compare.all_pairs(df, "y", "g").collect()}
    assert set(pairs) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert pairs["a", "c"]["t"] == pytest.approx((y["a"].mean() - y["c"].mean()) / math.sqrt(ssw / 33 * 2 / 12))
    assert all(p["p_tukey"] <= p["p_bonferroni"] + 1e-9 for p in pairs.values())
    same = {(p["level_a"], p["level_b"]): p for p in
            compare.model_contrasts(df, "y", "g", ["a", "b", "c"], {}).collect()}
    assert same["a", "c"]["t"] == pytest.approx(pairs["a", "c"]["t"], rel=1e-6)


def test_twoway_against_nested_fits(spark):
    rows, df = groups(spark, 3)
    rows = rows[:-4]                                        # unbalanced
    df = spark.createDataFrame(rows, "g string, b string, y double")
    y = np.array([v for *_, v in rows])
    a = np.array([[g == lv for lv in "abc"] for g, *_ in rows], float)
    b = np.array([[k == lv for lv in "uv"] for _, k, _ in rows], float)
    cell = (a[:, :, None] * b[:, None, :]).reshape(len(rows), -1)

    def rss(x):
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

    steps = [rss(np.ones((len(y), 1))), rss(a), rss(np.hstack([a, b])), rss(cell)]
    got = {r["term"]: r for r in compare.anova_twoway(df, "y", "g", "b").collect()}
    assert [got[t]["ss"] for t in ("g", "b", "g:b")] == pytest.approx(
        [steps[0] - steps[1], steps[1] - steps[2], steps[2] - steps[3]], abs=1e-8)
    assert got["residual"]["ss"] == pytest.approx(steps[3])


def surface(n=17, m=13, seed=1):
    return np.random.default_rng(seed).normal(100, 5, (n, m)).round(2)


def cells(spark, z):
    return spark.createDataFrame([(int(i), int(j), float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1])],
                                 "row int, col int, z double").repartition(3)


def grid(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.mark.parametrize("tile", [3, 256])
def test_neighbours_do_not_depend_on_tiles(spark, tile):
    z = surface()
    d = terrain.derivatives(cells(spark, z), 30.0, tile)
    tpi, rough = grid(d, "tpi", z.shape), grid(d, "roughness", z.shape)
    for i in range(z.shape[0]):
        for j in range(z.shape[1]):
            if 0 < i < z.shape[0] - 1 and 0 < j < z.shape[1] - 1:
                block = z[i - 1:i + 2, j - 1:j + 2]
                assert tpi[i, j] == pytest.approx(z[i, j] - (block.sum() - z[i, j]) / 8)
                assert rough[i, j] == pytest.approx(block.max() - block.min())
            else:
                assert math.isnan(tpi[i, j]) and math.isnan(rough[i, j])


def test_plane_has_known_slope_and_aspect(spark):
    i, j = np.mgrid[0:5, 0:5]
    d = terrain.derivatives(cells(spark, 100.0 - 3.0 * j), 30.0).filter("slope IS NOT NULL").collect()
    assert all(r["slope"] == pytest.approx(math.degrees(math.atan(0.1))) for r in d)
    assert all(r["aspect"] == pytest.approx(90.0) and r["flowdir"] == 1 for r in d)


def fill(z, rise):
    level = np.full(z.shape, np.inf)
    edge = np.zeros(z.shape, bool)
    edge[[0, -1]] = edge[:, [0, -1]] = True
    level[edge] = z[edge]
    while True:
        new = level.copy()
        for i in range(1, z.shape[0] - 1):
            for j in range(1, z.shape[1] - 1):
                low = min(level[i + a, j + b] + rise * math.hypot(a, b) for _, a, b in FLOW.values())
                new[i, j] = min(level[i, j], max(z[i, j], low))
        if np.array_equal(new, level):
            return level
        level = new


@pytest.mark.parametrize("tile", [4, 256])
def test_filling_and_upslope_cells(spark, tile):
    z = surface(11, 9, 2)
    filled = terrain.fill_depressions(cells(spark, z), tile)
    level = grid(filled, "filled", z.shape)
    assert level == pytest.approx(fill(z, 1e-4), abs=1e-9)
    flow = terrain.neighbours(filled.select("row", "col", F.col("filled").alias("z")), tile).select(
        "row", "col", terrain.flow_direction().alias("flowdir"))
    codes = grid(flow, "flowdir", z.shape)
    want = np.zeros(z.shape, int)
    steps = {v: (a, b) for v, a, b in FLOW.values()}
    for i in range(z.shape[0]):
        for j in range(z.shape[1]):
            r, c = i, j
            want[r, c] += 1
            while not math.isnan(codes[r, c]):
                a, b = steps[int(codes[r, c])]
                r, c = r + a, c + b
                want[r, c] += 1
    assert grid(terrain.upslope_cells(flow), "cells", z.shape) == pytest.approx(want)


def test_loops_are_reported(spark):
    loop = spark.createDataFrame([(0, 0, 1), (0, 1, 16)], "row int, col int, flowdir int")
    with pytest.raises(RuntimeError):
        terrain.upslope_cells(loop, max_rounds=5)


def test_crown_profile_against_all_levels(spark):
    rng = np.random.default_rng(7)
    rows = [(f"p{i % 3}", "BS" if i % 2 else "RS", float(t), float(t * rng.uniform(0.1, 0.9)))
            for i, t in enumerate(rng.uniform(10, 60, 45))]
    df = spark.createDataFrame(rows, "plot string, spp string, top double, base double")
    got = {(r["plot"], r["spp"], r["step"]): r["cr_points"] for r in
           crown.crown_profile(df, ["plot"], ["spp"], "top", "base").collect()}
    assert len(got) == 3 * 2 * 100
    for p in ("p0", "p1", "p2"):
        here = [r for r in rows if r[0] == p]
        high, low = max(r[2] for r in here), min(r[3] for r in here)
        for spp in ("BS", "RS"):
            for k in range(100):
                n = sum(math.ceil((b - low) / (high - low) * 99) <= k <= math.floor((t - low) / (high - low) * 99)
                        for _, s, t, b in here if s == spp)
                assert got[p, spp, k] == 10.0 * n


def test_projections(spark):
    df = spark.createDataFrame([(-69.0, 45.0), (-68.0, 44.8)], "lon double, lat double")
    x, y = spatial.transverse_mercator(F.col("lon"), F.col("lat"))
    wx, wy = spatial.web_mercator(F.col("lon"), F.col("lat"))
    a, b = df.select(x.alias("x"), y.alias("y"), wx.alias("wx"), wy.alias("wy")).collect()
    assert a["x"] == pytest.approx(500000.0) and a["y"] == pytest.approx(4982950.4, abs=0.1)
    assert b["x"] == pytest.approx(500000 + 79048, abs=60) and b["y"] > 4960000
    assert a["wx"] == pytest.approx(-69.0 / 180 * math.pi * 6378137) and a["wy"] == pytest.approx(5621521.486, abs=0.01)


def test_semivariogram_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(v)) for a, b, v in
            zip(rng.uniform(0, 100, 120), rng.uniform(0, 100, 120), rng.normal(50, 4, 120))]
    df = spark.createDataFrame(rows, "x double, y double, v double")
    got = {r["lag_class"]: r for r in spatial.semivariogram(df, "v", 10.0, 40.0, 10.0).collect()}
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            d = 10 * math.hypot(a[0] // 10 - b[0] // 10, a[1] // 10 - b[1] // 10)
            if d <= 40:
                want.setdefault(int(d // 10), []).append((a[2] - b[2]) ** 2)
    assert {k: r["pairs"] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[k]["gamma"] == pytest.approx(np.mean(v) / 2) for k, v in want.items())


def test_auc_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(int(y), float(np.round(1 / (1 + math.exp(-rng.normal(y, 1))), 2))) for y in rng.integers(0, 2, 400)]
    rows += [(0, 0.0), (1, 1.0)]
    pos, neg = ([s for y, s in rows if y == k] for k in (1, 0))
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    for per_unit in (1, 256):
        got = suitability.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s", per_unit).first()["auc"]
        assert got == pytest.approx(want)


def test_transgressive_uses_the_better_pure_stand(spark):
    rows = [("B2", "BN", 120.0), ("B2", "N", 100.0), ("B2", "B", 50.0), ("B3", "BR", 30.0), ("B3", "B", 60.0)]
    df = spark.createDataFrame(rows, "block string, code string, v double")
    got = {r["code"]: r["toy"] for r in yields.transgressive(df, "v").collect()}
    assert got == {"BN": pytest.approx(1.2), "BR": pytest.approx(0.5)}


def test_forest_importance_agrees_with_mllib_and_seeds_share_passes(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rng = np.random.default_rng(5)
    a, b, c, d = rng.normal(size=3000), rng.integers(0, 5, 3000), rng.normal(size=3000), rng.integers(0, 2, 3000)
    y = 4 * a + 2 * b + rng.normal(size=3000) / 2
    rows = [tuple(map(float, r)) for r in zip(y, a, b, c, d)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1.0), (9e9, None, 1.0, 1.0, 1.0)], "y double, a double, b double, c double, d double")
    terms, sc = ["a", "b", "c", "d"], spark.sparkContext
    data = VectorAssembler(inputCols=terms, outputCol="features").transform(df.dropna().withColumnRenamed("y", "label"))
    want = np.mean([RandomForestRegressor(numTrees=20, maxDepth=6, seed=s).fit(data).featureImportances.toArray() for s in (1, 2, 3)], axis=0)
    got = suitability.forest_importance(df, "y", terms).collect()
    assert [r["importance"] for r in got] == pytest.approx(want.tolist(), abs=0.06)
    assert [r["selected"] for r in got] == (want > want.mean()).tolist()
    assert sum(r["importance"] for r in got) == pytest.approx(1)
    jobs = []
    for seeds in ((1,), (1, 2, 3, 4)):
        sc.setJobGroup(f"forest {seeds}", "")
        suitability.forest_importance(df, "y", terms, seeds, trees=5, depth=2).collect()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"forest {seeds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_forest_sums_and_cuts_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(8)
    bins, y = rng.integers(0, 4, (2, 50)).astype(np.uint8), rng.normal(size=50)
    monkeypatch.setattr(suitability, "_DRAWS", np.full(1 << 16, 2, np.uint8))
    tried, term, cut = np.array([[[0, 1]] * 3]), np.array([[0, -1, -1]]), np.array([[1, 0, 0]])
    batch = suitability.pd.DataFrame([(7, bins.tobytes(), y.tobytes())], columns=["slice", "bins", "y"])
    sums = list(suitability._node_sums([(1, 0)], 1, tried, term, cut)(iter([batch])))[0]
    got = suitability._best_cuts(1, tried)(sums)
    for node, inside in ((1, bins[0] <= 1), (2, bins[0] > 1)):
        def squares(rows):
            return 2 * ((y[rows] - y[rows].mean()) ** 2).sum()

        want = max((squares(inside) - squares(inside & (bins[t] <= c)) - squares(inside & (bins[t] > c)), t, c) for t in (0, 1) for c in range(3)
                   if (inside & (bins[t] <= c)).any() and (inside & (bins[t] > c)).any())
        row = got[got["node"] == node].iloc[0]
        assert (row["gain"], row["term"], row["cut"]) == (pytest.approx(want[0]), want[1], want[2])
