import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from standlab import constants as K
from standlab.functions import columns as C
from standlab.operators import aggregates, clean, joins, reshape, windows
from standlab.session import literal_table, scratch_path
from standlab.sources import tables


def test_names_are_repaired(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`﻿OBJECTID` int, `` int, `DBH.23` int, `dbh 23` int")
    assert clean.clean_names(df).columns == ["objectid", "x1", "dbh_23", "dbh_23_"]


def test_csv_blanks_and_junk(spark):
    path = scratch_path(spark, "csv")
    text = spark.createDataFrame([("block,plot,uid,lai",), ("B2,1,,NA",), ("NA,x,u,2.5",), ("B3,,u,",)], "value string")
    text.coalesce(1).write.text(path)
    schema = tables._struct("block:s plot:i uid:s lai:d")
    rows = [tuple(r) for r in tables.load_table(spark, path, schema=schema).collect()]
    assert rows == [("B2", 1, "", None), (None, None, "u", 2.5), ("B3", None, "u", None)]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "g string, x double")
    rows = {r["g"]: r for r in df.groupBy("g").agg(
        C.strict_sum("x").alias("s"), C.strict_mean("x").alias("m"), F.sum("x").alias("k")).collect()}
    assert rows["a"]["s"] is None and rows["a"]["m"] is None and rows["a"]["k"] == 1.0
    assert rows["b"]["s"] == 6.0 and rows["b"]["m"] == 3.0


def test_bins_and_codes(spark):
    values = [0.0, 0.5, 1.0, 2.0, 2.5, 3.9, 4.0, 4.7]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(C.bin_round("x", 2.0), C.bin_cut("x", 1.0, F.lit(4.7)),
                     C.bin_cut("x", 1.0, F.lit(4.7), right=False)).collect()
    assert [r[0] for r in rows] == [2.0 * math.trunc((v + 1) / 2) for v in values]
    assert [r[1] for r in rows] == [1, 1, 1, 2, 3, 4, 4, None]
    assert [r[2] for r in rows] == [1, 1, 2, 3, 3, 4, None, None]
    codes = spark.createDataFrame([("WN",), ("B",), ("RN",)], "c string")
    assert [r[0] for r in codes.select(C.canonical_code("c")).collect()] == ["NW", "B", "NR"]


def test_finite_and_impute(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "x double")
    assert clean.finite_only(df, ["x"]).count() == 1
    out = clean.impute(clean.nan_to_null(df), "x", F.lit(9.0), "y", "flag").collect()
    assert sorted((r["y"], r["flag"]) for r in out) == [(1.0, 0), (9.0, 1), (9.0, 1), (math.inf, 0)]


def test_full_merge_equals_full_join(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(1, 10), (3, 30), (None, 99)], "k int, b int")
    got = sorted(map(str, joins.full_merge(a, b, ["k"]).collect()))
    assert got == sorted(map(str, a.join(b, ["k"], "full").collect()))


def test_fan_out_is_refused(spark):
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    assert joins.left_join(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError):
        joins.left_join(a, b, ["k"], assert_unique=True)


def test_widen_and_lengthen_round_trip(spark):
    df = spark.createDataFrame([(1, "BS", 0.25), (1, "RS", 0.75), (2, "NS", 1.0)], "p int, spp string, v double")
    wide = reshape.widen(df, ["p"], "spp", "v", K.SPECIES)
    long = reshape.lengthen(wide, ["p"], K.SPECIES, "spp", "v").filter("v > 0")
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, df.collect()))


def trees(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = [("hot" if i % 3 else f"p{i % 7}", f"t{i:04d}", float(rng.integers(1, 9)) / 4,
             None if i % 11 == 0 else float(rng.normal(30, 9))) for i in range(n)]
    return spark.createDataFrame(rows, "uid string, tree string, dbh double, ht double")


def test_running_sums_equal_brute_force(spark):
    df = trees(spark).withColumn("uid", F.when(F.col("uid") != "p1", F.col("uid")))
    specs = {"bal": ("dbh", F.col("dbh") * F.col("dbh")), "htl": ("ht", F.col("ht"))}
    got = windows.sums_before(df, ["uid"], specs, "tree")
    assert got.columns == [*df.columns, "bal", "htl"]
    rows = [r.asDict() for r in got.collect()]
    assert len(rows) == df.count() and any(r["uid"] is None for r in rows)
    for uid in {r["uid"] for r in rows}:
        plot = [r for r in rows if r["uid"] == uid]
        for order, name, measure in (("dbh", "bal", lambda r: r["dbh"] ** 2), ("ht", "htl", lambda r: r["ht"] or 0.0)):
            total = 0.0
            for r in sorted(plot, key=lambda r: (r[order] is None, -(r[order] or 0), r["tree"])):
                assert r[name] == pytest.approx(total)
                total += measure(r)


def test_running_sums_of_one_plot_of_equal_trees(spark):
    df = spark.range(6000).select(F.lit("p").alias("uid"), F.format_string("tree%06d", "id").alias("tree"), F.lit(5.0).alias("dbh"))
    got = windows.sums_before(df, ["uid"], {"before": ("dbh", F.lit(1.0))}, "tree")
    assert [r["before"] for r in got.orderBy("tree").collect()] == [float(i) for i in range(6000)]


def test_a_plot_of_equal_trees_lies_in_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(6000).select(F.lit("p").alias("uid"), F.col("id").alias("tree"), F.lit(5.0).alias("dbh"))
        ranged = df.repartitionByRange("uid", F.desc("dbh"), F.asc("tree")).groupBy(F.spark_partition_id().alias("p")).count()
        assert max(r["count"] for r in ranged.collect()) < 3000
        got = windows.sums_before(df, ["uid"], {"before": ("dbh", F.lit(1.0))}, "tree")
        assert [r["before"] for r in got.orderBy("tree").collect()] == [float(i) for i in range(6000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_top_mean_keeps_ties(spark):
    rows = [("a", d, h) for d, h in [(9.0, 1.0), (8.0, 2.0), (7.0, 3.0), (6.0, 4.0), (6.0, 6.0), (5.0, 99.0)]]
    df = spark.createDataFrame(rows, "uid string, dbh double, ht double")
    r = windows.top_mean(df, ["uid"], "dbh", "ht", 4).first()
    assert r["n_top"] == 5 and r["top_mean"] == pytest.approx(16 / 5)


def test_shares_and_totals(spark):
    df = trees(spark).withColumn("spp", F.when(F.col("dbh") > 1, "BS").otherwise("RS"))
    sums = windows.species_share(df, ["uid"]).groupBy("uid").agg(F.sum("proportion").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    carried = windows.with_group_total(df, ["uid"], total=F.sum("dbh"))
    assert carried.count() == df.count()


@pytest.mark.parametrize("bins", [1, 7, 2048])
def test_exact_quantiles(spark, bins):
    rng = np.random.default_rng(1)
    data = {"a": rng.exponential(2, 501), "b": rng.integers(0, 4, 300).astype(float), "c": np.array([5.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in data.items() for v in x], "g string, x double")
    probs = dict(zip(aggregates.FIVE, aggregates.PROBS))
    for r in aggregates.exact_quantiles(df, ["g"], "x", probs, bins).collect():
        want = np.quantile(data[r["g"]], aggregates.PROBS)
        assert [r[c] for c in aggregates.FIVE] == pytest.approx(want.tolist())


@pytest.mark.parametrize("bins", [3, 64])
def test_exact_quantiles_narrow_their_brackets(spark, bins):
    rng = np.random.default_rng(2)
    data = {"far": np.append(rng.normal(10, 1, 120), [1e12, -1e300, 1e300]),
            "hot": np.concatenate([np.full(90, 7.0), rng.normal(7, 1e-9, 40), [np.nextafter(7, 8)]]),
            None: rng.integers(-3, 3, 80).astype(float), "one": np.array([2.5]), "equal": np.full(50, -1.0)}
    df = spark.createDataFrame([(g, float(v)) for g, x in data.items() for v in x], "g string, x double")
    probs = dict(zip(aggregates.FIVE, aggregates.PROBS))
    got = {r["g"]: r for r in aggregates.exact_quantiles(df, ["g"], "x", probs, bins, few=5).collect()}
    assert got.keys() == data.keys()
    for g, x in data.items():
        assert [got[g][c] for c in aggregates.FIVE] == pytest.approx(np.quantile(x, aggregates.PROBS).tolist(), rel=1e-12)
        assert got[g]["n"] == len(x)


def test_exact_quantiles_of_values_without_end(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in [inf, -inf, inf, 1.0, 2.0, 3.0, 4.0, None, float("nan")]], "x double")
    row = aggregates.exact_quantiles(df, [], "x", {"low": 0.0, "mid": 3 / 7, "top": 6 / 7, "end": 1.0}, bins=4, few=1).first()
    assert (row["low"], row["mid"], row["top"], row["n"]) == (-inf, 3.0, inf, 8) and row["end"] != row["end"]
    assert aggregates.exact_quantiles(df.filter("x > 9e9 AND x < 0"), [], "x", {"m": 0.5}).count() == 0


def test_literal_table_keeps_nulls(spark):
    rows = [("a'b", None), ("c", 2.5)]
    assert sorted(map(tuple, literal_table(spark, rows, "k string, v double").collect()), key=str) == sorted(rows, key=str)


def test_null_groups_keep_their_totals_and_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 6.0)], "g string, x double")
    totals = {(r["g"], r["x"]): r["t"] for r in windows.with_group_total(df, ["g"], t=F.sum("x")).collect()}
    assert totals == {("a", 1.0): 4.0, ("a", 3.0): 4.0, (None, 2.0): 8.0, (None, 6.0): 8.0}
    five = {r["g"]: (r["n"], r["q50"]) for r in aggregates.five_number(df, ["g"], "x", continuous=True).collect()}
    assert five == {"a": (2, 2.0), None: (2, 4.0)}
    right = spark.createDataFrame([(None, 9), ("b", 7)], "g string, v int")
    assert {r["g"]: r["v"] for r in joins.left_join(df, right, ["g"], na_matches=True).collect()} == {"a": None, None: 9}
    assert joins.inner_merge(df, right, ["g"], na_matches=True).count() == 2
    assert joins.inner_merge(df, right, ["g"]).count() == 0


def test_literals_that_are_not_numbers(spark):
    row = literal_table(spark, [(float("nan"), float("inf"), None)], "a double, b double, c double").first()
    assert row["a"] != row["a"] and row["b"] == float("inf") and row["c"] is None
