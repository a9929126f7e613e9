"""Sources, cleaning, joins, aggregates, windows and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from standlab import constants as K
from standlab.functions import columns as C
from standlab.operators import aggregates, clean, joins, reshape, stand, windows
from standlab.plans.registry import query
from standlab.session import literal_table, scratch_path
from standlab.sources import tables

SP = "'BS','NS','RS','WS'"


# -- sources and sinks ----------------------------------------------------------------------

@query("csv_round_trip", "SRC1 SNK1", "trees", """
SELECT block, plot, tree, spp, code, status, dbh, round(ht, 6) AS ht FROM trees""")
def _(t):
    path = scratch_path(t.spark, "trees")
    cols = [f.name for f in tables.SCHEMAS["trees"] if f.name in t.trees.columns]
    out = t.trees.select(*cols, (F.col("hcb") * 0.75).alias("llb_ht"))
    ordered = out.select(*[f.name for f in tables.SCHEMAS["trees"]])
    ordered.write.option("header", True).csv(path, nullValue="NA")
    back = tables.load_table(t.spark, path, "trees")
    return back.select("block", "plot", "tree", "spp", "code", "status", "dbh",
                       F.round("ht", 6).alias("ht"))


@query("summary_sink", "SNK1", "live", """
SELECT block, plot, count(*) AS n_trees, sum(dbh) AS dbh_sum FROM live GROUP BY 1, 2""")
def _(t):
    path = scratch_path(t.spark, "summary")
    rows = t.live.groupBy("block", "plot").agg(F.count(F.lit(1)).alias("n_trees"),
                                               F.sum("dbh").alias("dbh_sum"))
    tables.write_summary(rows, path)
    return t.spark.read.parquet(path)


@query("text_to_number", "SRC2 CLN4", "trees", """
SELECT uid, tree, TRY_CAST(CASE WHEN ln = 6 THEN 'n/a' ELSE CAST(dbh AS VARCHAR) END AS DOUBLE) AS dbh,
 coalesce(TRY_CAST(CASE WHEN ln = 6 THEN 'n/a' ELSE CAST(dbh AS VARCHAR) END AS DOUBLE), 0.0::DOUBLE) AS dbh0
FROM trees""")
def _(t):
    text = F.when(F.col("ln") == 6, "n/a").otherwise(F.col("dbh").cast("string"))
    return (t.trees.select("uid", "tree", C.to_number(text).alias("dbh"))
            .withColumn("dbh0", F.coalesce("dbh", F.lit(0.0))))


@query("cell_stack_round_trip", "SRC3 SNK2", "cells", """
SELECT row, col, z AS elevation, z * 2 AS doubled FROM cells""")
def _(t):
    path = scratch_path(t.spark, "cells")
    tables.write_cells(t.cells.withColumn("z2", F.col("z") * 2), path, tile=64)
    return tables.load_cells(t.spark, path, ["elevation", "doubled"]).drop("tile")


# -- cleaning -------------------------------------------------------------------------------

@query("whole_row_distinct", "CLN1", "stemform", """
SELECT DISTINCT block, plot, spp, dam1, dam2, dam3 FROM stemform""")
def _(t):
    return t.stemform.select("block", "plot", "spp", "dam1", "dam2", "dam3").distinct()


@query("keep_first_by_key", "CLN2", "stemform", """
SELECT * FROM stemform QUALIFY row_number() OVER (PARTITION BY block, plot, tree ORDER BY copy) = 1""")
def _(t):
    return clean.dedupe_by(t.stemform, ["block", "plot", "tree"], ["copy"])


@query("live_spruce_filter", "CLN3", "trees", f"""
SELECT uid, tree, spp, code, dbh FROM trees
WHERE status = 1 AND spp IN ({SP}) AND code <> 'C' AND NOT (code = 'NR' AND spp = 'BS')""")
def _(t):
    return t.trees.filter(
        (F.col("status") == 1) & F.col("spp").isin(K.SPECIES) & (F.col("code") != K.CONTROL)
        & ~((F.col("code") == "NR") & (F.col("spp") == "BS"))
    ).select("uid", "tree", "spp", "code", "dbh")


@query("exclude_misplanted", "CLN3", "live", """
SELECT uid, tree, spp, code FROM live
WHERE NOT (code = 'BW' AND spp = 'RS') AND NOT (code = 'NR' AND spp = 'BS')
 AND NOT (code = 'RW' AND spp IN ('NS', 'BS'))
 AND NOT (code = 'C' AND spp IN ('NS', 'BS'))""")
def _(t):
    pairs = literal_table(t.spark, K.MISPLANTED + [("C", "NS"), ("C", "BS")],
                          "code string, spp string")
    return clean.exclude_pairs(t.live.select("uid", "tree", "spp", "code"), pairs)


@query("null_to_zero", "CLN4", "trees", """
SELECT uid, tree, round(coalesce(ht, 0), 6) AS ht, round(coalesce(hcb, 0), 6) AS hcb,
 coalesce(lai, 0) AS lai FROM trees""")
def _(t):
    return clean.fill_null(t.trees.select("uid", "tree", "ht", "hcb", "lai"), 0.0).select(
        "uid", "tree", F.round("ht", 6).alias("ht"), F.round("hcb", 6).alias("hcb"), "lai")


@query("drop_null_rows", "CLN5 CLN4", "trees", """
SELECT uid, tree, dbh, lai FROM trees WHERE ht IS NOT NULL AND hcb IS NOT NULL AND lai IS NOT NULL""")
def _(t):
    rows = clean.drop_null_rows(t.trees, ["ht", "hcb"])
    return clean.drop_sentinel(rows, "lai").select("uid", "tree", "dbh", "lai")


@query("finite_ratios", "CLN6", "trees", """
SELECT uid, tree, round(ht / nullif(dbh - 2, 0), 6) AS slender FROM trees
WHERE ht IS NOT NULL AND dbh <> 2""")
def _(t):
    rows = t.trees.withColumn("slender", C.ratio("ht", F.col("dbh") - 2))
    return clean.finite_only(rows, ["slender"]).select(
        "uid", "tree", F.round("slender", 6).alias("slender"))


@query("bound_rules", "CLN7", "trees", """
SELECT uid, tree, round(CASE WHEN ht < 30 THEN ht ELSE 0 END, 6) AS ht,
 round(CASE WHEN hcb < 5 THEN 5 ELSE hcb END, 6) AS hcb, least(dbh / 10, 1) AS class
FROM trees""")
def _(t):
    return t.trees.select(
        "uid", "tree", F.round(F.when(F.col("ht") < 30, F.col("ht")).otherwise(0.0), 6).alias("ht"),
        F.round(C.clamp("hcb", low=5.0), 6).alias("hcb"),
        C.clamp(F.col("dbh") / 10, high=1.0).alias("class"))


@query("composite_key", "CLN8", "trees", """
SELECT DISTINCT concat(block, '.', CAST(plot AS VARCHAR)) AS uid, block, plot FROM trees""")
def _(t):
    return t.trees.select(C.plot_uid().alias("uid"), "block", "plot").distinct()


@query("split_keys", "CLN9 UD1", "trees", """
SELECT DISTINCT uid, split_part(uid, '.', 1) AS block, CAST(split_part(uid, '.', 2) AS BIGINT) AS plot,
 code, concat(substr(code, 1, 1), 'S') AS spec1,
 CASE WHEN length(code) = 2 THEN concat(substr(code, 2, 1), 'S') END AS spec2 FROM trees""")
def _(t):
    return t.trees.select(
        "uid", C.key_part("uid", ".", 0).alias("block"),
        C.key_part("uid", ".", 1).cast("bigint").alias("plot"), "code",
        C.code_species("code", 1).alias("spec1"), C.code_species("code", 2).alias("spec2")).distinct()


@query("unit_conversion", "CLN10", "trees", """
SELECT uid, tree, round(dbh * 2.54::DOUBLE, 6) AS dbh_cm, round(dbh * 0.0254::DOUBLE, 6) AS dbh_m,
 round(ht * 0.3048::DOUBLE, 6) AS ht_m, round(ht / 3.28::DOUBLE, 6) AS ht_m_coarse,
 round(ht / 3.28::DOUBLE * 3.28::DOUBLE, 6) AS ht_ft, round(dbh * 2.54::DOUBLE * 0.3937::DOUBLE, 6) AS dbh_in,
 10.0::DOUBLE * 2.47::DOUBLE AS tph, round(dbh * dbh * 0.005454::DOUBLE * 10 / 4.356::DOUBLE, 6) AS baph FROM trees""")
def _(t):
    return t.trees.select(
        "uid", "tree", F.round(C.inches_to_cm("dbh"), 6).alias("dbh_cm"),
        F.round(C.inches_to_m("dbh"), 6).alias("dbh_m"), F.round(C.feet_to_m("ht"), 6).alias("ht_m"),
        F.round(C.feet_to_m_coarse("ht"), 6).alias("ht_m_coarse"),
        F.round(C.m_to_feet(C.feet_to_m_coarse("ht")), 6).alias("ht_ft"),
        F.round(C.cm_to_inches(C.inches_to_cm("dbh")), 6).alias("dbh_in"),
        C.per_acre_to_per_ha(F.lit(10.0)).alias("tph"),
        F.round(C.basal_area_to_metric(C.basal_area("dbh") * 10), 6).alias("baph"))


@query("stand_type", "CLN11", "live", """
SELECT CASE WHEN length(code) = 2 THEN 'Mixed' WHEN code <> 'C' THEN 'Monoculture' END AS stand_type,
 count(*) AS n, sum(dbh) AS dbh_sum FROM live GROUP BY 1""")
def _(t):
    return (t.live.withColumn("stand_type", C.stand_type("code")).groupBy("stand_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("dbh").alias("dbh_sum")))


@query("class_binning", "CLN12", "live", """
SELECT uid, tree, 5.0::DOUBLE * trunc((dbh * 4 + 2.5) / 5) AS mark,
 CASE WHEN dbh < floor(m) THEN CAST(floor(dbh) + 1 AS INTEGER) END AS left_closed,
 CASE WHEN dbh * 2.54::DOUBLE <= floor(m * 2.54::DOUBLE / 3) * 3
  THEN CAST(greatest(ceil(dbh * 2.54::DOUBLE / 3), 1) AS INTEGER) END AS right_closed
FROM live, (SELECT max(dbh) AS m FROM live)""")
def _(t):
    top = t.live.agg(F.max("dbh")).scalar()
    return t.live.select(
        "uid", "tree", C.bin_round(F.col("dbh") * 4, 5.0).alias("mark"),
        C.bin_cut("dbh", 1.0, top, right=False).alias("left_closed"),
        C.bin_cut(C.inches_to_cm("dbh"), 3.0, C.inches_to_cm(top)).alias("right_closed"))


@query("nan_to_null", "CLN13", "trees", """
SELECT uid, tree, CASE WHEN dbh > 6 THEN dbh END AS big, round(ht, 6) AS ht FROM trees""")
def _(t):
    rows = t.trees.select("uid", "tree", F.when(F.col("dbh") > 6, F.col("dbh"))
                          .otherwise(float("nan")).alias("big"), F.round("ht", 6).alias("ht"))
    return clean.nan_to_null(rows)


@query("rename_columns", "CLN14 CLN17", "live", """
SELECT uid, dbh AS "dbh.23", code AS "code.23", lai FROM live""")
def _(t):
    rows = clean.select_at(t.live.select("block", "uid", "dbh", "plot", "code", "lai"), [2, 3, 5, 6])
    return clean.suffix(rows, ["dbh", "code"], ".23")


@query("impute_height", "CLN15 MD3", "live coef", """
SELECT uid, tree, round(coalesce(ht, 4.5::DOUBLE + exp(ht_a + ht_b / (dbh + 1))), 6) AS final_ht,
 CASE WHEN ht IS NULL THEN 1 ELSE 0 END AS imputed FROM live JOIN coef USING (spp)""")
def _(t):
    rows = clean.impute(stand.predict_height(t.live, t.coef), "ht", "ht_fit", "final_ht", "imputed")
    return rows.select("uid", "tree", F.round("final_ht", 6).alias("final_ht"), "imputed")


@query("factor_levels", "CLN16", "live", """
SELECT spp, CAST(list_position(['BS','NS','RS','WS'], spp) AS BIGINT) AS spp_level,
 CAST(list_position(['B','N','R','W','BN','BR','BW','NR','NW','RW'], code) AS BIGINT) AS code_level,
 count(*) AS n FROM live GROUP BY ALL""")
def _(t):
    return (t.live.select("spp", C.level_order("spp", K.SPECIES).alias("spp_level"),
                          C.level_order("code", K.PURE + K.MIXED).alias("code_level"))
            .groupBy("spp", "spp_level", "code_level").agg(F.count(F.lit(1)).alias("n")))


@query("canonical_treatment", "CLN18", "plots", """
SELECT block, plot, raw_code, CASE WHEN length(raw_code) = 2 AND substr(raw_code, 1, 1) > substr(raw_code, 2, 1)
 THEN reverse(raw_code) ELSE raw_code END AS code FROM plots""")
def _(t):
    return t.plots.withColumn("code", C.canonical_code("raw_code"))


@query("null_audit", "CLN19", "trees site", """
SELECT 'ht' AS column_name, count(*) - count(ht) AS n_null, count(*) AS n_rows FROM trees
UNION ALL SELECT 'hcb', count(*) - count(hcb), count(*) FROM trees
UNION ALL SELECT 'lai', count(*) - count(lai), count(*) FROM trees
UNION ALL SELECT 'dbh', count(*) - count(dbh), count(*) FROM trees
UNION ALL SELECT 'redox', count(*) - count(redox), count(*) FROM site""")
def _(t):
    return clean.null_audit(t.trees.select("ht", "hcb", "lai", "dbh")).unionByName(
        clean.null_audit(t.site.select("redox")))


@query("distinct_treatments", "CLN19", "trees", "SELECT DISTINCT code, spp FROM trees")
def _(t):
    return t.trees.select("code", "spp").distinct()


# -- joins ----------------------------------------------------------------------------------

@query("trees_with_stemform_and_site", "JN1", "trees stemform site", """
WITH first_form AS (SELECT * FROM stemform
 QUALIFY row_number() OVER (PARTITION BY block, plot, tree ORDER BY copy DESC) = 1 AND dam1 <> 'SN')
SELECT t.uid, t.tree, t.spp, t.dbh, f.dam1, f.deduct1, s.dep, s.ph
FROM trees t LEFT JOIN first_form f ON t.block = f.block AND t.plot = f.plot AND t.tree = f.tree AND t.spp = f.spp
LEFT JOIN site s ON t.block = s.block AND t.plot = s.plot WHERE t.code <> 'C'""")
def _(t):
    first = clean.dedupe_by(t.stemform, ["block", "plot", "tree"], [F.desc("copy")])
    form = first.filter("dam1 <> 'SN'").select("block", "plot", "tree", "spp", "dam1", "deduct1")
    rows = t.trees.filter(F.col("code") != K.CONTROL).select("block", "plot", "uid", "tree", "spp", "dbh")
    rows = joins.left_join(rows, form, ["block", "plot", "tree", "spp"])
    return joins.left_join(rows, t.site.select("block", "plot", "dep", "ph"), ["block", "plot"],
                           assert_unique=True).drop("block", "plot")


@query("plot_metrics_on_trees", "JN1 UD4", "live", """
SELECT l.uid, l.tree, s.bapa, s.tpa FROM live l LEFT JOIN (
 SELECT uid, sum(dbh * dbh) * 0.005454::DOUBLE * 10.0::DOUBLE AS bapa, count(*) * 10.0::DOUBLE AS tpa
 FROM live GROUP BY uid) s ON l.uid = s.uid""")
def _(t):
    density = stand.stand_density(t.live, ["uid"]).select("uid", "bapa", "tpa")
    return joins.left_join(t.live.select("uid", "tree"), density, ["uid"])


@query("natural_left_join", "JN2", "live site", """
SELECT p.block, p.plot, p.uid, p.n_trees, s.dep, s.slope
FROM (SELECT block, plot, uid, count(*) AS n_trees FROM live GROUP BY ALL) p
LEFT JOIN (SELECT block, plot, uid, dep, slope FROM site WHERE slope > 3) s
 ON p.block = s.block AND p.plot = s.plot AND p.uid = s.uid""")
def _(t):
    plots = t.live.groupBy("block", "plot", "uid").agg(F.count(F.lit(1)).alias("n_trees"))
    site = t.site.filter("slope > 3").select("block", "plot", "uid", "dep", "slope")
    return joins.natural_left(plots, site)


@query("inner_merge", "JN3", "live", """
SELECT uid, tree, spp, model_spp FROM live
JOIN (VALUES ('BS', 'black'), ('NS', 'norway'), ('RS', 'red')) m(spp, model_spp) USING (spp)""")
def _(t):
    names = literal_table(t.spark, [("BS", "black"), ("NS", "norway"), ("RS", "red")],
                          "spp string, model_spp string")
    return joins.inner_merge(t.live.select("uid", "tree", "spp"), names, ["spp"])


@query("full_outer_merge", "JN4", "live site", """
SELECT coalesce(p.uid, s.uid) AS uid, p.n_trees, s.dep
FROM (SELECT uid, count(*) AS n_trees FROM live WHERE dbh > 12 GROUP BY uid) p
FULL JOIN (SELECT uid, dep FROM site WHERE dep > 40) s ON p.uid = s.uid""")
def _(t):
    plots = t.live.filter("dbh > 12").groupBy("uid").agg(F.count(F.lit(1)).alias("n_trees"))
    return joins.full_merge(plots, t.site.filter("dep > 40").select("uid", "dep"), ["uid"])


_EFFECTS = """e1 AS (SELECT * FROM (VALUES ('BS', 0.5::DOUBLE), ('NS', -0.25::DOUBLE), ('XX', 1.0::DOUBLE)) t(spp, b_spp)),
e2 AS (SELECT spp, block, avg(dbh) - 6 AS b_block FROM live WHERE spp <> 'RS' GROUP BY ALL),
e3 AS (SELECT spp, block, plot, avg(dbh) - 7 AS b_plot FROM live WHERE dbh > 9 GROUP BY ALL)"""


def _effects(t):
    spp = literal_table(t.spark, [("BS", 0.5), ("NS", -0.25), ("XX", 1.0)], "spp string, b_spp double")
    block = t.live.filter("spp <> 'RS'").groupBy("spp", "block").agg(
        (F.avg("dbh") - 6).alias("b_block"))
    plot = t.live.filter("dbh > 9").groupBy("spp", "block", "plot").agg(
        (F.avg("dbh") - 7).alias("b_plot"))
    return [(spp, ["spp"], "b_spp"), (block, ["spp", "block"], "b_block"),
            (plot, ["spp", "block", "plot"], "b_plot")]


@query("level_effects", "JN5", "live", f"""
WITH {_EFFECTS}
SELECT uid, tree, round(coalesce(b_spp, 0) + coalesce(b_block, 0) + coalesce(b_plot, 0), 6) AS effect
FROM live LEFT JOIN e1 USING (spp) LEFT JOIN e2 USING (spp, block) LEFT JOIN e3 USING (spp, block, plot)""")
def _(t):
    rows = joins.add_effects(t.live.select("uid", "tree", "spp", "block", "plot"), _effects(t))
    return rows.select("uid", "tree", F.round("effect", 6).alias("effect"))


@query("level_effects_outer", "JN5 JN4", "live", f"""
WITH {_EFFECTS}
SELECT spp, count(*) AS n_rows, count(tree) AS n_trees, round(sum(coalesce(b_spp, 0) + coalesce(b_block, 0) + coalesce(b_plot, 0)), 4) AS total
FROM live FULL JOIN e1 USING (spp) FULL JOIN e2 USING (spp, block) FULL JOIN e3 USING (spp, block, plot) GROUP BY spp""")
def _(t):
    rows = joins.add_effects(t.live.select("uid", "tree", "spp", "block", "plot"), _effects(t), how="full")
    return rows.groupBy("spp").agg(F.count(F.lit(1)).alias("n_rows"), F.count("tree").alias("n_trees"),
                                   F.round(F.sum("effect"), 4).alias("total"))


@query("proportion_grid", "JN6", "trees", """
SELECT uid, i AS step, i / 99.0::DOUBLE AS prop FROM (SELECT DISTINCT uid FROM trees),
 (SELECT CAST(range AS INTEGER) AS i FROM range(100))""")
def _(t):
    return joins.expand_grid(t.trees.select("uid").distinct(), 100)


@query("pure_stand_reference", "JN7 RS3", "stems", """
WITH m AS (SELECT block, code, avg(v) AS v FROM (SELECT block, plot, code, sum(vol) AS v FROM stems GROUP BY ALL) GROUP BY ALL)
SELECT x.block, x.code, round(x.v, 6) AS v, round(b.v, 6) AS "B", round(n.v, 6) AS "N", round(r.v, 6) AS "R", round(w.v, 6) AS "W"
FROM m x LEFT JOIN m b ON b.block = x.block AND b.code = 'B' LEFT JOIN m n ON n.block = x.block AND n.code = 'N'
LEFT JOIN m r ON r.block = x.block AND r.code = 'R' LEFT JOIN m w ON w.block = x.block AND w.code = 'W'""")
def _(t):
    plots = t.stems.groupBy("block", "plot", "code").agg(F.sum("vol").alias("v"))
    means = plots.groupBy("block", "code").agg(F.avg("v").alias("v"))
    wide = joins.attach_pure(means, means, "v", K.PURE)
    return wide.select("block", "code", *[F.round(c, 6).alias(c) for c in ["v", *K.PURE]])


# -- aggregates -----------------------------------------------------------------------------

@query("count_by_group", "AG1", "live", """
SELECT block, plot, spp, count(*) AS tree_ct FROM live GROUP BY ALL""")
def _(t):
    return t.live.groupBy("block", "plot", "spp").agg(F.count(F.lit(1)).alias("tree_ct"))


@query("strict_and_skipping", "AG2 FM26 UD4", "live", """
SELECT uid, CASE WHEN count(ht) = count(*) THEN round(sum(ht), 6) END AS strict_sum, round(sum(ht), 6) AS skip_sum,
 CASE WHEN count(lai) = count(*) THEN avg(lai) END AS strict_lai, avg(lai) AS skip_lai,
 CASE WHEN count(hcb) = count(*) THEN round(min(hcb), 6) END AS strict_min, round(min(hcb), 6) AS skip_min,
 CASE WHEN count(ht) = count(*) THEN round(max(ht), 6) END AS strict_max, round(max(ht), 6) AS skip_max
FROM live GROUP BY uid""")
def _(t):
    return t.live.groupBy("uid").agg(
        F.round(C.strict_sum("ht"), 6).alias("strict_sum"), F.round(F.sum("ht"), 6).alias("skip_sum"),
        C.strict_mean("lai").alias("strict_lai"), F.avg("lai").alias("skip_lai"),
        F.round(C.strict_min("hcb"), 6).alias("strict_min"), F.round(F.min("hcb"), 6).alias("skip_min"),
        F.round(C.strict_max("ht"), 6).alias("strict_max"), F.round(F.max("ht"), 6).alias("skip_max"))


@query("sd_and_se", "AG3", "live", """
SELECT code, round(avg(ht), 6) AS mean_ht, round(stddev_samp(ht), 6) AS sd_ht,
 round(stddev_samp(ht) / sqrt(count(*)), 6) AS se_ht FROM live GROUP BY code""")
def _(t):
    return t.live.groupBy("code").agg(
        F.round(F.avg("ht"), 6).alias("mean_ht"), F.round(F.stddev_samp("ht"), 6).alias("sd_ht"),
        F.round(C.std_error("ht"), 6).alias("se_ht"))


@query("replicate_then_treatment", "AG4", "live", """
SELECT code, spp, round(avg(m), 6) AS mean_dbh, round(stddev_samp(m), 6) AS sd_dbh, round(min(m), 6) AS min_dbh,
 round(max(m), 6) AS max_dbh FROM (SELECT code, block, plot, spp, avg(dbh) AS m FROM live GROUP BY ALL) GROUP BY ALL""")
def _(t):
    return aggregates.two_level(t.live, ["code", "block", "plot", "spp"], ["code", "spp"], "dbh")


@query("chained_summary", "AG5 FM3 FM4", "live", """
SELECT uid, bapa, tpa, round(sqrt(bapa / (0.005454::DOUBLE * tpa)), 6) AS qmd,
 round(bapa / sqrt(sqrt(bapa / (0.005454::DOUBLE * tpa))), 6) AS rd
FROM (SELECT uid, sum(dbh * dbh) * 0.005454::DOUBLE * 10.0::DOUBLE AS bapa, count(*) * 10.0::DOUBLE AS tpa FROM live GROUP BY uid)""")
def _(t):
    rows = stand.stand_density(t.live, ["uid"]).select("uid", "bapa", "tpa")
    rows = rows.withColumn("qmd", C.qmd("bapa", "tpa"))
    return rows.select("uid", "bapa", "tpa", F.round("qmd", 6).alias("qmd"),
                       F.round(C.relative_density("bapa", "qmd"), 6).alias("rd"))


@query("plot_constant_mean", "AG6", "live", """
SELECT l.block, l.plot, round(avg(s.rs), 6) AS rs FROM live l JOIN (
 SELECT uid, sqrt(43560.0::DOUBLE / (count(*) * 10.0::DOUBLE)) / max(dbh) AS rs FROM live GROUP BY uid) s USING (uid)
GROUP BY l.block, l.plot""")
def _(t):
    rows = windows.with_group_total(t.live.select("block", "plot", "uid", "dbh"), ["uid"],
                                    n=F.count(F.lit(1)), top=F.max("dbh"))
    rs = C.relative_spacing(F.col("n") * 10.0, "top")
    return rows.groupBy("block", "plot").agg(F.round(F.avg(rs), 6).alias("rs"))


@query("rounded_range", "AG7", "live", """
SELECT code, spp, round(min(dbh * 0.37::DOUBLE), 1) AS min_v, round(max(dbh * 0.37::DOUBLE), 1) AS max_v,
 round(round(max(dbh * 0.37::DOUBLE), 1) - round(min(dbh * 0.37::DOUBLE), 1), 1) AS range_v FROM live GROUP BY ALL""")
def _(t):
    return aggregates.rounded_range(t.live.withColumn("v", F.col("dbh") * 0.37), ["code", "spp"], "v", 1)


@query("five_number_summary", "AG8", "live", """
SELECT code, count(dbh) AS n, round(avg(dbh), 6) AS mean, quantile_cont(dbh, 0) AS q0, quantile_cont(dbh, 0.25) AS q25,
 quantile_cont(dbh, 0.5) AS q50, quantile_cont(dbh, 0.75) AS q75, quantile_cont(dbh, 1) AS q100 FROM live GROUP BY code""")
def _(t):
    return aggregates.five_number(t.live, ["code"], "dbh", continuous=False)


@query("continuous_quantiles", "AG8", "live", """
SELECT code, count(ht) AS n, round(avg(ht), 6) AS mean, round(quantile_cont(ht, 0), 6) AS q0, round(quantile_cont(ht, 0.25), 6) AS q25,
 round(quantile_cont(ht, 0.5), 6) AS q50, round(quantile_cont(ht, 0.75), 6) AS q75, round(quantile_cont(ht, 1), 6) AS q100
FROM live GROUP BY code""")
def _(t):
    rows = aggregates.five_number(t.live, ["code"], "ht")
    return rows.select("code", "n", "mean", *[F.round(c, 6).alias(c) for c in aggregates.FIVE])


@query("share_invariant", "AG9 FM16", "live", """
SELECT uid, round(sum(n / t), 6) AS checker FROM (
 SELECT uid, spp, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY uid) AS t FROM live GROUP BY uid, spp) GROUP BY uid""")
def _(t):
    shares = stand.importance_values(t.live, ["uid"])
    broken = stand.share_check(shares, ["uid"], "iv").select("uid", F.lit(True).alias("broken"))
    return (shares.groupBy("uid").agg(F.round(F.sum("iv"), 6).alias("checker"))
            .join(broken, "uid", "left_anti"))


@query("plot_and_species_totals", "AG10", "live", """
SELECT block, plot, spp, sum(dbh * dbh) * 0.005454::DOUBLE * 10.0::DOUBLE AS bapa, count(*) * 10.0::DOUBLE AS tpa
FROM live GROUP BY GROUPING SETS ((block, plot), (block, plot, spp))""")
def _(t):
    return stand.plot_species_totals(t.live, ["block", "plot"])


# -- windows --------------------------------------------------------------------------------

@query("species_share", "WN1", "live", """
SELECT block, plot, spp, n AS tree_ct, CAST(sum(n) OVER (PARTITION BY block, plot) AS BIGINT) AS t_trees,
 n / sum(n) OVER (PARTITION BY block, plot) AS proportion
FROM (SELECT block, plot, spp, count(*) AS n FROM live GROUP BY ALL)""")
def _(t):
    return windows.species_share(t.live, ["block", "plot"])


def _bal():
    return F.col("dbh") * F.col("dbh")


@query("basal_area_larger", "WN2", "live", """
SELECT uid, tree, coalesce(sum(dbh * dbh) OVER (PARTITION BY uid ORDER BY dbh DESC, tree
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.005454::DOUBLE * 10.0::DOUBLE AS bal FROM live""")
def _(t):
    rows = windows.sums_before(t.live.select("uid", "tree", "dbh"), ["uid"], {"d2": ("dbh", _bal())}, "tree")
    return rows.select("uid", "tree", (F.col("d2") * K.BASAL_AREA_FT2 * K.TREES_PER_ACRE).alias("bal"))


@query("height_larger", "WN3", "stems", """
SELECT uid, tree, round(coalesce(sum(final_ht) OVER (PARTITION BY uid ORDER BY final_ht DESC, tree
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS htl FROM stems""")
def _(t):
    rows = windows.sums_before(t.stems.select("uid", "tree", "final_ht"), ["uid"],
                               {"htl": ("final_ht", F.col("final_ht"))}, "tree")
    return rows.select("uid", "tree", F.round("htl", 6).alias("htl"))


@query("competition_larger", "WN2 WN3", "stems", """
SELECT uid, tree, coalesce(sum(dbh * dbh) OVER (PARTITION BY uid ORDER BY dbh DESC, tree
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.005454::DOUBLE * 10.0::DOUBLE AS bal,
 round(coalesce(sum(final_ht) OVER (PARTITION BY uid ORDER BY final_ht DESC, tree
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS htl FROM stems""")
def _(t):
    rows = windows.sums_before(
        t.stems.select("uid", "tree", "dbh", "final_ht"), ["uid"],
        {"d2": ("dbh", _bal()), "htl": ("final_ht", F.col("final_ht"))}, "tree")
    return rows.select("uid", "tree", (F.col("d2") * K.BASAL_AREA_FT2 * K.TREES_PER_ACRE).alias("bal"),
                       F.round("htl", 6).alias("htl"))


@query("group_total_on_rows", "WN4 FM13", "stems", """
SELECT uid, tree, round(sum(vol) OVER (PARTITION BY uid) * 10 * 2.47105::DOUBLE, 6) AS vol_ha,
 round(sum(vol) OVER (PARTITION BY uid) * 10 * 2.47105::DOUBLE * 14.28::DOUBLE, 5) AS vol_ac FROM stems""")
def _(t):
    rows = windows.with_group_total(t.stems.select("uid", "tree", "vol"), ["uid"], v=F.sum("vol"))
    ha = F.col("v") * K.TREES_PER_ACRE * K.ACRES_PER_HA_FINE
    return rows.select("uid", "tree", F.round(ha, 6).alias("vol_ha"),
                       F.round(ha * K.M3_HA_TO_FT3_AC, 5).alias("vol_ac"))


@query("top_height", "WN5 FM11", "stems", """
SELECT block, plot, round(avg(final_ht), 6) AS ht_40, count(*) AS n_top FROM (
 SELECT *, rank() OVER (PARTITION BY block, plot ORDER BY dbh DESC) AS r FROM stems) WHERE r <= 4 GROUP BY ALL""")
def _(t):
    rows = windows.top_mean(t.stems, ["block", "plot"], "dbh", "final_ht", 4, "ht_40")
    return rows.withColumn("ht_40", F.round("ht_40", 6))


@query("largest_trees", "WN6", "live", """
SELECT uid, tree, spp, dbh FROM live ORDER BY dbh DESC, uid, tree LIMIT 30""")
def _(t):
    return windows.first_rows(t.live.select("uid", "tree", "spp", "dbh"), [F.desc("dbh"), "uid", "tree"], 30)


# -- reshape --------------------------------------------------------------------------------

@query("stacked_samples", "RS1", "live", """
SELECT 'Mixture' AS sample, uid, avg(dbh) AS dbh FROM live WHERE code = 'BR' GROUP BY uid
UNION ALL SELECT 'BestMono', uid, avg(dbh) FROM live WHERE code = 'B' GROUP BY uid""")
def _(t):
    plots = t.live.groupBy("code", "uid").agg(F.avg("dbh").alias("dbh"))
    return reshape.stack_samples({"Mixture": plots.filter("code = 'BR'"),
                                  "BestMono": plots.filter("code = 'B'")}).drop("code")


@query("species_columns_first", "RS2 CLN14", "live", """
SELECT block, plot, coalesce(max(n) FILTER (spp = 'BS'), 0) AS "BS.rd", coalesce(max(n) FILTER (spp = 'NS'), 0) AS "NS.rd",
 coalesce(max(n) FILTER (spp = 'RS'), 0) AS "RS.rd", coalesce(max(n) FILTER (spp = 'WS'), 0) AS "WS.rd"
FROM (SELECT block, plot, spp, count(*) / sum(count(*)) OVER (PARTITION BY block, plot) AS n FROM live GROUP BY block, plot, spp)
GROUP BY block, plot""")
def _(t):
    shares = windows.species_share(t.live, ["block", "plot"])
    return reshape.widen(shares, ["block", "plot"], "spp", "proportion", K.SPECIES, ".rd")


@query("species_columns_mean", "RS3", "live", """
SELECT uid, avg(dbh) FILTER (spp = 'BS') AS "BS", avg(dbh) FILTER (spp = 'NS') AS "NS",
 avg(dbh) FILTER (spp = 'RS') AS "RS", avg(dbh) FILTER (spp = 'WS') AS "WS" FROM live GROUP BY uid""")
def _(t):
    return reshape.widen(t.live, ["uid"], "spp", "dbh", K.SPECIES, agg=F.avg, fill=None)


@query("damage_long", "RS4", "stemform", """
SELECT block, plot, tree, copy, dam_num, dam_value FROM (
 SELECT block, plot, tree, copy, unnest(['dam1', 'dam2', 'dam3']) AS dam_num, unnest([dam1, dam2, dam3]) AS dam_value FROM stemform)""")
def _(t):
    return reshape.lengthen(t.stemform, ["block", "plot", "tree", "copy"], ["dam1", "dam2", "dam3"],
                            "dam_num", "dam_value")


@query("treatment_summary", "FM1 FM2 FM3 FM11 AG3 WN5", "stems", """
WITH p AS (SELECT code, uid, sum(dbh * dbh) * 0.005454::DOUBLE * 10 AS bapa, count(*) * 10 AS tpa,
  sqrt(sum(dbh * dbh) / count(*)) AS qmd FROM stems GROUP BY code, uid),
h AS (SELECT uid, avg(final_ht) AS ht_40 FROM (SELECT *, rank() OVER (PARTITION BY uid ORDER BY dbh DESC) AS r FROM stems) WHERE r <= 4 GROUP BY uid)
SELECT code, count(*) AS n_plots, round(avg(bapa), 3) AS bapa, round(stddev_samp(bapa) / sqrt(count(*)), 6) AS bapa_se,
 round(avg(tpa), 6) AS tpa, round(avg(qmd), 6) AS qmd, round(stddev_samp(qmd) / sqrt(count(*)), 6) AS qmd_se,
 round(avg(ht_40), 6) AS ht_40, round(stddev_samp(ht_40) / sqrt(count(*)), 6) AS ht_40_se
FROM p JOIN h USING (uid) GROUP BY code""")
def _(t):
    density = stand.stand_density(t.stems, ["code", "uid"])
    top = windows.top_mean(t.stems, ["uid"], "dbh", "final_ht", 4, "ht_40")
    return density.join(top, "uid").groupBy("code").agg(
        F.count(F.lit(1)).alias("n_plots"),
        *[F.round(F.avg(c), d).alias(c) for c, d in {"bapa": 3, "tpa": 6, "qmd": 6, "ht_40": 6}.items()],
        *[F.round(C.std_error(c), 6).alias(c + "_se") for c in ["bapa", "qmd", "ht_40"]])
