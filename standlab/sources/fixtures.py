"""Inventory tables derived from the sample star schema, for checks and benchmarks.

The tree list these operators are meant for is not public, so each sample order line
stands for a tree and each part for a plot.  All values and coefficients are synthetic.
Every view exists twice, as a DataFrame and as SQL text, so results can be compared.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from standlab.session import literal_table

# synthetic coefficients: height curve, crown width, stem volume, site curve
COEF = [
    ("BS", 3.55, -4.9, 3.2, 0.62, 0.00004, 1.90, 0.95, 0.020, 1.10),
    ("NS", 3.65, -5.3, 3.6, 0.66, 0.00005, 1.85, 1.00, 0.024, 1.15),
    ("RS", 3.50, -5.1, 3.4, 0.64, 0.000045, 1.88, 0.97, 0.018, 1.20),
    ("WS", 3.60, -5.0, 3.5, 0.65, 0.000048, 1.87, 0.98, 0.022, 1.12),
]
COEF_COLUMNS = ["spp", "ht_a", "ht_b", "cw_a", "cw_b", "vol_a", "vol_b", "vol_c", "si_k", "si_m"]

SQL = {
    "trees": ((), """trees AS (
 SELECT concat('B', CAST(l_partkey % 3 + 2 AS VARCHAR)) AS block, l_partkey AS plot,
  concat('B', CAST(l_partkey % 3 + 2 AS VARCHAR), '.', CAST(l_partkey AS VARCHAR)) AS uid,
  concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
    CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS tree,
  code,
  concat(CASE WHEN code = 'C' THEN substr('BNRW', l_linenumber % 4 + 1, 1)
    WHEN length(code) = 1 THEN code
    WHEN l_linenumber % 2 = 1 THEN substr(code, 1, 1) ELSE substr(code, 2, 1) END, 'S') AS spp,
  CASE WHEN l_linestatus = 'O' OR l_linenumber <= 5 THEN 1 ELSE 0 END AS status,
  l_quantity / 4.0::DOUBLE AS dbh,
  CASE WHEN l_tax = 0.0 THEN NULL ELSE 4.5::DOUBLE + exp(3.6::DOUBLE - 5.0::DOUBLE / (l_quantity / 4.0::DOUBLE + 1)) * (0.9::DOUBLE + 2 * l_discount) END AS ht,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE (4.5::DOUBLE + exp(3.6::DOUBLE - 5.0::DOUBLE / (l_quantity / 4.0::DOUBLE + 1))) * (0.2::DOUBLE + 2 * l_discount) END AS hcb,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 2.0::DOUBLE + (l_partkey % 40) / 8.0::DOUBLE END AS lai,
  l_linenumber AS ln, l_discount AS disc, l_tax AS tax, l_returnflag AS rf, l_linestatus AS ls
 FROM (SELECT *, ['B','N','R','W','BN','BR','BW','NR','NW','RW','C'][(l_partkey // 3) % 11 + 1] AS code FROM lineitem))"""),
    "live": (("trees",), "live AS (SELECT * FROM trees WHERE status = 1)"),
    "coef": ((), "coef AS (SELECT * FROM (VALUES " + ", ".join(
        "('" + r[0] + "', " + ", ".join(f"{v!r}::DOUBLE" for v in r[1:]) + ")" for r in COEF)
        + ") t(" + ", ".join(COEF_COLUMNS) + "))"),
    "stems": (("live", "coef"), """stems AS (
 SELECT *, vol_a * pow(dbh * 2.54::DOUBLE, vol_b) * pow(final_ht / 3.28::DOUBLE, vol_c) AS vol,
  cw_a * pow(dbh, cw_b) AS cw
 FROM (SELECT l.*, c.* EXCLUDE (spp), 4.5::DOUBLE + exp(ht_a + ht_b / (dbh + 1)) AS ht_fit,
   coalesce(ht, 4.5::DOUBLE + exp(ht_a + ht_b / (dbh + 1))) AS final_ht
  FROM live l JOIN coef c ON l.spp = c.spp))"""),
    "site": ((), """site AS (
 SELECT concat('B', CAST(p_partkey % 3 + 2 AS VARCHAR)) AS block, p_partkey AS plot,
  concat('B', CAST(p_partkey % 3 + 2 AS VARCHAR), '.', CAST(p_partkey AS VARCHAR)) AS uid,
  20.0::DOUBLE + p_size AS dep, p_retailprice / 16.0::DOUBLE AS elevation,
  ((p_partkey * 7) % 13) / 4.0::DOUBLE AS winds, 4.0::DOUBLE + ((p_partkey * 11) % 17) / 8.0::DOUBLE AS ph,
  3.0::DOUBLE + ((p_partkey * 5) % 23) / 4.0::DOUBLE AS swi, 150.0::DOUBLE + (p_partkey * 3) % 29 AS rad,
  ((p_partkey * 13) % 31) / 2.0::DOUBLE AS slope, 10.0::DOUBLE + ((p_partkey * 17) % 19) / 8.0::DOUBLE AS tmax,
  8.0::DOUBLE + ((p_partkey * 19) % 11) / 8.0::DOUBLE AS vpdmax, 1000.0::DOUBLE + (p_partkey * 23) % 101 AS ppt,
  CASE WHEN p_partkey % 5 < 2 THEN NULL ELSE 25.0::DOUBLE + p_partkey % 9 END AS redox
 FROM part)"""),
    "plots": (("trees",), """plots AS (
 SELECT DISTINCT block, plot, CASE WHEN plot % 2 = 0 THEN reverse(code) ELSE code END AS raw_code FROM trees)"""),
    "stemform": (("trees",), """stemform AS (
 SELECT block, plot, tree, spp, copy,
  CASE ln WHEN 1 THEN 'FK' WHEN 2 THEN 'WV' WHEN 3 THEN 'FK/WV' WHEN 4 THEN 'SN' WHEN 5 THEN 'WV/FK' ELSE '' END AS dam1,
  CAST(round(disc * 500) AS INTEGER) + copy - 1 AS deduct1,
  CASE rf WHEN 'A' THEN 'SPK/WV' WHEN 'R' THEN 'WV' ELSE '' END AS dam2,
  CAST(round(tax * 400) AS INTEGER) AS deduct2,
  CASE WHEN ls = 'O' AND tax > 0.045 THEN 'BF/WV' ELSE '' END AS dam3,
  CASE WHEN ls = 'O' AND tax > 0.045 THEN 10 END AS deduct3
 FROM (SELECT *, 1 AS copy FROM trees UNION ALL SELECT *, 2 AS copy FROM trees WHERE ln = 7))"""),
    "cells": ((), """cells AS (
 SELECT CAST(p_partkey // 40 AS INTEGER) AS row, CAST(p_partkey % 40 AS INTEGER) AS col,
  p_retailprice / 100.0::DOUBLE + p_size / 10.0::DOUBLE AS z FROM part)"""),
    "points": ((), """points AS (
 SELECT c_custkey AS id, -69.5::DOUBLE + (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS lon,
  44.5::DOUBLE + (c_custkey * 61 % 1000) / 1000.0::DOUBLE AS lat,
  (c_custkey * 37 % 1000) * 1.2::DOUBLE AS x, (c_custkey * 61 % 1000) * 1.5::DOUBLE AS y,
  c_acctbal AS resid FROM customer)"""),
}


def with_views(names: str, query: str) -> str:
    """SQL text with the named views, and the views they need, in front."""
    order: list[str] = []

    def need(name):
        for dep in SQL[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    head = "WITH " + ",\n".join(SQL[n][1] for n in order)
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + body[15:]
    return head + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)


class Inputs:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def trees(self) -> DataFrame:
        part, ln, qty = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity")
        codes = F.array(*[F.lit(c) for c in
                          ["B", "N", "R", "W", "BN", "BR", "BW", "NR", "NW", "RW", "C"]])
        block = F.concat(F.lit("B"), (part % 3 + 2).cast("string"))
        dbh = qty / 4.0
        curve = F.exp(3.6 - 5.0 / (dbh + 1))
        code = F.col("code")
        letter = (F.when(code == "C", F.substr(F.lit("BNRW"), ln % 4 + 1, F.lit(1)))
                  .when(F.length(code) == 1, code)
                  .when(ln % 2 == 1, F.substring(code, 1, 1))
                  .otherwise(F.substring(code, 2, 1)))
        return (self.table("lineitem")
                .withColumn("code", F.get(codes, F.floor(part / 3) % 11))
                .select(
                    block.alias("block"), part.alias("plot"),
                    F.concat_ws(".", block, part.cast("string")).alias("uid"),
                    F.concat_ws("-", "l_orderkey", ln, "l_suppkey",
                                F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("tree"),
                    "code", F.concat(letter, F.lit("S")).alias("spp"),
                    F.when((F.col("l_linestatus") == "O") | (ln <= 5), 1).otherwise(0).alias("status"),
                    dbh.alias("dbh"),
                    F.when(F.col("l_tax") != 0.0,
                           4.5 + curve * (0.9 + 2 * F.col("l_discount"))).alias("ht"),
                    F.when(F.col("l_returnflag") != "N",
                           (4.5 + curve) * (0.2 + 2 * F.col("l_discount"))).alias("hcb"),
                    F.when(part % 17 != 0, 2.0 + (part % 40) / 8.0).alias("lai"),
                    ln.alias("ln"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
                    F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls")))

    @cached_property
    def live(self) -> DataFrame:
        # status = 1, written on stored columns so that the scan can skip rows
        return self.trees.filter("ls = 'O' OR ln <= 5")

    @cached_property
    def coef(self) -> DataFrame:
        schema = "spp string, " + ", ".join(f"{c} double" for c in COEF_COLUMNS[1:])
        return literal_table(self.spark, COEF, schema)

    @cached_property
    def stems(self) -> DataFrame:
        """Live trees with filled heights, crown width and volume."""
        from standlab.operators import stand
        return stand.tree_metrics(self.live, self.coef)

    @cached_property
    def site(self) -> DataFrame:
        p = F.col("p_partkey")
        block = F.concat(F.lit("B"), (p % 3 + 2).cast("string"))
        return self.table("part").select(
            block.alias("block"), p.alias("plot"),
            F.concat_ws(".", block, p.cast("string")).alias("uid"),
            (20.0 + F.col("p_size")).alias("dep"), (F.col("p_retailprice") / 16.0).alias("elevation"),
            ((p * 7) % 13 / 4.0).alias("winds"), (4.0 + (p * 11) % 17 / 8.0).alias("ph"),
            (3.0 + (p * 5) % 23 / 4.0).alias("swi"), (150.0 + (p * 3) % 29).alias("rad"),
            ((p * 13) % 31 / 2.0).alias("slope"), (10.0 + (p * 17) % 19 / 8.0).alias("tmax"),
            (8.0 + (p * 19) % 11 / 8.0).alias("vpdmax"), (1000.0 + (p * 23) % 101).alias("ppt"),
            F.when(p % 5 >= 2, 25.0 + p % 9).alias("redox"))

    @cached_property
    def plots(self) -> DataFrame:
        return (self.trees.select("block", "plot", "code").distinct()
                .select("block", "plot", F.when(F.col("plot") % 2 == 0, F.reverse("code"))
                        .otherwise(F.col("code")).alias("raw_code")))

    @cached_property
    def stemform(self) -> DataFrame:
        ln, tax = F.col("ln"), F.col("tax")
        first = F.get(F.array(*[F.lit(v) for v in ["", "FK", "WV", "FK/WV", "SN", "WV/FK", "", ""]]), ln)
        third = (F.col("ls") == "O") & (tax > 0.045)
        copies = F.when(ln == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return (self.trees.withColumn("copy", F.explode(copies))
                .select("block", "plot", "tree", "spp", "copy", first.alias("dam1"),
                        (F.round(F.col("disc") * 500).cast("int") + F.col("copy") - 1).alias("deduct1"),
                        F.when(F.col("rf") == "A", "SPK/WV").when(F.col("rf") == "R", "WV")
                        .otherwise("").alias("dam2"),
                        F.round(tax * 400).cast("int").alias("deduct2"),
                        F.when(third, "BF/WV").otherwise("").alias("dam3"),
                        F.when(third, 10).alias("deduct3")))

    @cached_property
    def cells(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.table("part").select(
            F.floor(p / 40).cast("int").alias("row"), (p % 40).cast("int").alias("col"),
            (F.col("p_retailprice") / 100.0 + F.col("p_size") / 10.0).alias("z"))

    @cached_property
    def points(self) -> DataFrame:
        c = F.col("c_custkey")
        u, v = c * 37 % 1000, c * 61 % 1000
        return self.table("customer").select(
            c.alias("id"), (-69.5 + u / 1000.0).alias("lon"), (44.5 + v / 1000.0).alias("lat"),
            (u * 1.2).alias("x"), (v * 1.5).alias("y"), F.col("c_acctbal").alias("resid"))
