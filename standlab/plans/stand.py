"""Tree, plot and treatment metrics, crown profile, damage, mixture yield."""

from __future__ import annotations

from pyspark.sql import functions as F

from standlab import constants as K
from standlab.functions import columns as C
from standlab.operators import clean, crown, damage, dist, reshape, stand, yields
from standlab.plans.registry import query


def rounded(df, keep, cols, digits=6):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in cols])


@query("tree_basal_area", "FM1", "trees", """
SELECT uid, tree, dbh * dbh * 0.005454::DOUBLE AS ba FROM trees""")
def _(t):
    return t.trees.select("uid", "tree", C.basal_area("dbh").alias("ba"))


_DENSITY = """sum(dbh * dbh) * 0.005454::DOUBLE * 10.0::DOUBLE AS bapa, count(*) * 10.0::DOUBLE AS tpa,
 round(sqrt(sum(dbh * dbh) / count(*)), 9) AS qmd,
 round(sum(dbh * dbh) * 0.005454::DOUBLE * 10.0::DOUBLE / sqrt(sqrt(sum(dbh * dbh) / count(*))), 9) AS rd,
 round(count(*) * 10.0::DOUBLE * pow(sqrt(sum(dbh * dbh) / count(*)) / 10.0::DOUBLE, 1.605::DOUBLE), 9) AS sdi"""


@query("stand_density_plot", "FM2 FM3 FM4 FM5", "live", f"""
SELECT block, plot, uid, code, count(*) AS n_trees, {_DENSITY} FROM live GROUP BY ALL""")
def _(t):
    rows = stand.stand_density(t.live, stand.PLOT)
    return rounded(rows, [*stand.PLOT, "n_trees", "bapa", "tpa"], ["qmd", "rd", "sdi"], 9)


@query("stand_density_species", "FM2 FM3 FM4 FM5", "live", f"""
SELECT block, plot, spp, count(*) AS n_trees, {_DENSITY} FROM live GROUP BY block, plot, spp""")
def _(t):
    rows = stand.stand_density(t.live, ["block", "plot", "spp"])
    return rounded(rows, ["block", "plot", "spp", "n_trees", "bapa", "tpa"], ["qmd", "rd", "sdi"], 9)


@query("relative_spacing", "FM6 WN5 JN2", "stems", """
SELECT p.block, p.plot, round(sqrt(43560.0::DOUBLE / p.tpa) / h.ht_40 * 100, 6) AS rs FROM
 (SELECT block, plot, count(*) * 10.0::DOUBLE AS tpa FROM stems GROUP BY ALL) p JOIN
 (SELECT block, plot, avg(final_ht) AS ht_40 FROM (SELECT *, rank() OVER (PARTITION BY block, plot ORDER BY dbh DESC) AS r FROM stems)
  WHERE r <= 4 GROUP BY ALL) h USING (block, plot)""")
def _(t):
    from standlab.operators import windows
    plots = t.stems.groupBy("block", "plot").agg((F.count(F.lit(1)) * 10.0).alias("tpa"))
    top = windows.top_mean(t.stems, ["block", "plot"], "dbh", "final_ht", 4, "ht_40")
    rs = C.relative_spacing("tpa", "ht_40") * 100
    return plots.join(top, ["block", "plot"]).select("block", "plot", F.round(rs, 6).alias("rs"))


@query("maximum_crown_width", "FM7 UD1", "stems", "SELECT uid, tree, round(cw, 6) AS cw FROM stems")
def _(t):
    return rounded(t.stems, ["uid", "tree"], ["cw"])


@query("crown_competition_strict", "FM8", "stems", """
SELECT block, plot, round(CASE WHEN count(c) = count(*) THEN 100 * sum(pi() * pow(c / 2, 2) * 10) / 43560 END, 6) AS ccf
FROM (SELECT block, plot, CASE WHEN dbh > 0.25 THEN cw END AS c FROM stems) GROUP BY ALL""")
def _(t):
    rows = t.stems.withColumn("c", F.when(F.col("dbh") > 0.25, F.col("cw")))
    return rounded(stand.crown_competition(rows, ["block", "plot"], "c"), ["block", "plot"], ["ccf"])


@query("crown_competition_skipping", "FM8", "stems", """
SELECT block, plot, round(100 * sum(pi() * pow(c / 2, 2) * 10) / 43560, 6) AS ccf
FROM (SELECT block, plot, CASE WHEN dbh > 0.25 THEN cw END AS c FROM stems) GROUP BY ALL""")
def _(t):
    rows = t.stems.withColumn("c", F.when(F.col("dbh") > 0.25, F.col("cw")))
    return rounded(stand.crown_competition(rows, ["block", "plot"], "c", strict=False),
                   ["block", "plot"], ["ccf"])


@query("height_diameter_ratio", "FM9 AG4 CLN6", "stems", """
SELECT code, spp, round(avg(m), 6) AS mean_hdr, round(stddev_samp(m), 6) AS sd_hdr, round(min(m), 6) AS min_hdr, round(max(m), 6) AS max_hdr
FROM (SELECT code, block, plot, spp, avg(final_ht * 0.3048::DOUBLE / (dbh * 0.0254::DOUBLE)) AS m FROM stems WHERE dbh > 0 GROUP BY ALL) GROUP BY ALL""")
def _(t):
    rows = stand.height_diameter_ratio(t.stems, ["code", "block", "plot", "spp"], ["code", "spp"])
    return rounded(rows, ["code", "spp"], ["mean_hdr", "sd_hdr", "min_hdr", "max_hdr"])


@query("site_index_plot", "FM10 UD1", "stems", """
SELECT block, plot, round(avg(si), 6) AS mean_si, round(avg(si * pow(1 - exp(-si_k * 28), si_m) / pow(1 - exp(-si_k * 50), si_m)), 6) AS top_height
FROM (SELECT *, final_ht * pow(1 - exp(-si_k * 50), si_m) / pow(1 - exp(-si_k * 28), si_m) AS si FROM stems) GROUP BY block, plot""")
def _(t):
    return rounded(stand.site_summary(t.stems, ["block", "plot"], 28), ["block", "plot"],
                   ["mean_si", "top_height"])


@query("stem_volume", "FM12 UD1", "stems", "SELECT uid, tree, round(vol, 8) AS vol FROM stems")
def _(t):
    return rounded(t.stems, ["uid", "tree"], ["vol"], 8)


@query("plot_volume", "FM13", "stems", """
SELECT block, plot, round(sum(vol) * 10 * 2.47105::DOUBLE, 6) AS vol_ha, round(sum(vol) * 10 * 2.47105::DOUBLE * 14.28::DOUBLE, 5) AS vol_ac
FROM stems GROUP BY block, plot""")
def _(t):
    ha = F.sum("vol") * K.TREES_PER_ACRE * K.ACRES_PER_HA_FINE
    return t.stems.groupBy("block", "plot").agg(
        F.round(ha, 6).alias("vol_ha"), F.round(ha * K.M3_HA_TO_FT3_AC, 5).alias("vol_ac"))


@query("plot_summary", "FM13 AG5 FM26 UD4", "stems", """
SELECT *, round(sqrt(bapa / (tpa * 0.005454::DOUBLE)), 6) AS qmd, round(bapa / sqrt(sqrt(bapa / (tpa * 0.005454::DOUBLE))), 6) AS rd,
 round(tpa * pow(sqrt(bapa / (tpa * 0.005454::DOUBLE)) / 10, 1.605::DOUBLE), 6) AS sdi FROM (
SELECT block, plot, uid, code, sum(dbh * dbh) * 0.005454::DOUBLE * 10.0::DOUBLE AS bapa, count(*) * 10.0::DOUBLE AS tpa,
 round(sum(pi() * pow(cw / 2, 2) * 10) / 43560 * 100, 6) AS ccf, avg(lai) AS lai, round(sum(vol * 10) * 2.47::DOUBLE, 6) AS vol_ha
FROM stems GROUP BY block, plot, uid, code)""")
def _(t):
    return rounded(stand.plot_summary(t.stems), [*stand.PLOT, "bapa", "tpa", "lai"],
                   ["ccf", "vol_ha", "qmd", "rd", "sdi"])


def _deducted(t):
    form = clean.dedupe_by(t.stemform, ["block", "plot", "tree"], ["copy"])
    form = damage.total_deduction(form, ["deduct1", "deduct2", "deduct3"])
    return form.select("block", "plot", "tree", "t_deduct", "deduct_class")


_DEDUCTED = """deducted AS (SELECT block, plot, tree, t_deduct, 5.0::DOUBLE * trunc((t_deduct + 2.5::DOUBLE) / 5) AS deduct_class FROM (
 SELECT block, plot, tree, (coalesce(deduct1, 0) + coalesce(deduct2, 0) + coalesce(deduct3, 0)) / 3 AS t_deduct FROM stemform
 QUALIFY row_number() OVER (PARTITION BY block, plot, tree ORDER BY copy) = 1))"""


@query("deduction_class", "FM14 CLN12", "stemform", f"WITH {_DEDUCTED} SELECT * FROM deducted")
def _(t):
    return _deducted(t)


@query("merchantable_volume", "FM15 CLN7 AG2", "stems stemform", f"""
WITH {_DEDUCTED}, v AS (SELECT block, plot, sum(vol) * 10 * 2.47105::DOUBLE AS p_vol_ha FROM stems GROUP BY ALL),
m AS (SELECT s.block, s.plot, s.code, s.vol, v.p_vol_ha, v.p_vol_ha * 14.28::DOUBLE AS p_vol_ac, d.deduct_class, 2 + 0.8::DOUBLE * d.t_deduct AS fit_deduction,
 least(5.0::DOUBLE * trunc((2 + 0.8::DOUBLE * d.t_deduct + 2.5::DOUBLE) / 5) / 100, 1) AS fit_deduct_class
 FROM stems s LEFT JOIN deducted d USING (block, plot, tree) LEFT JOIN v USING (block, plot))
SELECT block, plot, code, round(avg(vol), 6) AS new_vol_m3, round(avg(p_vol_ha), 6) AS p_vol_ha, round(avg(p_vol_ac), 5) AS p_vol_ac,
 round(avg(deduct_class), 6) AS deduct_class, round(avg(fit_deduction), 6) AS fit_deduction, round(avg(fit_deduct_class), 9) AS fit_deduct_class,
 round(avg(p_vol_ac * fit_deduct_class), 5) AS adj_vol, round(avg(p_vol_ac - p_vol_ac * fit_deduct_class), 5) AS final_vol,
 round(avg((p_vol_ac - p_vol_ac * fit_deduct_class) * 0.0698::DOUBLE), 6) AS merch_vol_ha FROM m GROUP BY block, plot, code""")
def _(t):
    plots = t.stems.groupBy("block", "plot").agg(
        (F.sum("vol") * K.TREES_PER_ACRE * K.ACRES_PER_HA_FINE).alias("p_vol_ha"))
    rows = (t.stems.join(_deducted(t), ["block", "plot", "tree"], "left")
            .join(plots, ["block", "plot"], "left")
            .withColumn("p_vol_ac", F.col("p_vol_ha") * K.M3_HA_TO_FT3_AC)
            .withColumn("fit_deduction", 2 + 0.8 * F.col("t_deduct")))
    rows = damage.merchantable(rows, "p_vol_ac", "fit_deduction").withColumnRenamed("vol", "new_vol_m3")
    digits = {"new_vol_m3": 6, "p_vol_ha": 6, "p_vol_ac": 5, "deduct_class": 6, "fit_deduction": 6,
              "fit_deduct_class": 9, "adj_vol": 5, "final_vol": 5, "merch_vol_ha": 6}
    return rows.groupBy("block", "plot", "code").agg(
        *[F.round(F.avg(c), d).alias(c) for c, d in digits.items()])


@query("importance_values", "FM16 AG10", "live", """
WITH s AS (SELECT block, plot, spp, count(*) AS n, sum(dbh * dbh) AS d2 FROM live GROUP BY ALL)
SELECT block, plot, spp, round(n / sum(n) OVER w, 6) AS prop_tpa, round(d2 / sum(d2) OVER w, 6) AS prop_ba,
 round((n / sum(n) OVER w + d2 / sum(d2) OVER w) / 2, 6) AS iv FROM s WINDOW w AS (PARTITION BY block, plot)""")
def _(t):
    return rounded(stand.importance_values(t.live, ["block", "plot"]), ["block", "plot", "spp"],
                   ["prop_tpa", "prop_ba", "iv"])


_RATIOS = """s AS (SELECT uid, spp, sum(dbh * dbh) AS d2, count(*) AS n, sum(vol) AS v FROM stems GROUP BY uid, spp),
r AS (SELECT uid, spp, (d2 / sqrt(sqrt(d2 / n))) / (sum(d2) OVER w / sqrt(sqrt(sum(d2) OVER w / sum(n) OVER w))) AS rel_rd,
 v / sum(v) OVER w AS rel_vol FROM s WINDOW w AS (PARTITION BY uid))"""


@query("species_shares_wide", "FM17 RS3 CLN14 AG10", "stems", f"""
WITH {_RATIOS}
SELECT uid, round(coalesce(max(rel_rd) FILTER (spp = 'BS'), 0), 6) AS "BS.rd", round(coalesce(max(rel_rd) FILTER (spp = 'NS'), 0), 6) AS "NS.rd",
 round(coalesce(max(rel_rd) FILTER (spp = 'RS'), 0), 6) AS "RS.rd", round(coalesce(max(rel_rd) FILTER (spp = 'WS'), 0), 6) AS "WS.rd",
 round(coalesce(max(rel_vol) FILTER (spp = 'BS'), 0), 6) AS "BS.rv", round(coalesce(max(rel_vol) FILTER (spp = 'NS'), 0), 6) AS "NS.rv",
 round(coalesce(max(rel_vol) FILTER (spp = 'RS'), 0), 6) AS "RS.rv", round(coalesce(max(rel_vol) FILTER (spp = 'WS'), 0), 6) AS "WS.rv"
FROM r GROUP BY uid""")
def _(t):
    ratios = stand.species_ratios(t.stems, ["uid"])
    wide = [reshape.widen(ratios, ["uid"], "spp", v, K.SPECIES, s, agg=F.avg)
            for v, s in (("rel_rd", ".rd"), ("rel_vol", ".rv"))]
    both = wide[0].join(wide[1], "uid", "left")
    return both.select("uid", *[F.round(f"`{c}`", 6).alias(c) for c in both.columns if c != "uid"])


@query("share_of_trees", "FM17 RS2", "live", """
SELECT uid, spp, round(count(*) / sum(count(*)) OVER (PARTITION BY uid), 6) AS rel FROM live GROUP BY uid, spp""")
def _(t):
    from standlab.operators import windows
    rows = windows.species_share(t.live, ["uid"])
    return rows.select("uid", "spp", F.round("proportion", 6).alias("rel"))


@query("crown_ratios", "FM18", "stems", """
SELECT uid, tree, round((final_ht - hcb) / final_ht, 6) AS lcr, round((final_ht - hcb) / final_ht * 100, 6) AS cr_percent,
 round(final_ht - 0.45::DOUBLE * final_ht, 6) AS fit_hcb, round(CASE WHEN hcb IS NULL OR hcb < 1 THEN final_ht - 0.45::DOUBLE * final_ht ELSE hcb END, 6) AS hcb
FROM stems""")
def _(t):
    lcr = C.live_crown_ratio("final_ht", "hcb")
    fit = C.crown_base("final_ht", F.lit(0.45))
    rows = t.stems.withColumns({"lcr": lcr, "cr_percent": lcr * 100, "fit_hcb": fit})
    gap = F.col("hcb").isNull() | (F.col("hcb") < 1)
    rows = clean.impute(rows, "hcb", "fit_hcb", "hcb", missing=gap)
    return rounded(rows, ["uid", "tree"], ["lcr", "cr_percent", "fit_hcb", "hcb"])


_CROWNS = """k AS (SELECT block, plot, spp, code, final_ht, CASE WHEN base < 0.3 THEN 0.3::DOUBLE ELSE base END AS base
 FROM (SELECT *, coalesce(hcb, 0.55::DOUBLE * final_ht) - 1 AS base FROM stems)),
f AS (SELECT block, plot, max(final_ht) AS top, min(base) AS low FROM k GROUP BY ALL),
g AS (SELECT k.*, ceil((base - low) / nullif(top - low, 0) * 99) AS a, floor((final_ht - low) / nullif(top - low, 0) * 99) AS b FROM k JOIN f USING (block, plot)),
profile AS (SELECT block, plot, spp, code, CAST(i.range AS INTEGER) AS step, i.range / 99.0::DOUBLE AS prop,
 count(*) FILTER (i.range >= a AND i.range <= b) * 10.0::DOUBLE AS cr_points FROM g, range(100) i GROUP BY ALL)"""


def crowns(t):
    base = C.clamp(F.coalesce("hcb", F.col("final_ht") * 0.55) - 1, low=0.3)
    return t.stems.withColumn("base", base)


def profile(t):
    return crown.crown_profile(crowns(t), ["block", "plot"], ["spp", "code"], "final_ht", "base")


@query("crown_profile", "FM19 JN6", "stems", f"WITH {_CROWNS} SELECT * FROM profile")
def _(t):
    return profile(t)


@query("crown_profile_average", "FM19 AG4", "stems", f"""
WITH {_CROWNS} SELECT code, spp, step, prop, round(avg(cr_points), 6) AS cr_points FROM profile
WHERE cr_points > 0 AND length(code) = 2 GROUP BY code, spp, step, prop""")
def _(t):
    rows = crown.average_profile(profile(t).filter(F.length("code") == 2), ["code", "spp"])
    return rows.withColumn("cr_points", F.round("cr_points", 6))


@query("crown_profile_beta", "DS2 FM19 UD2", "stems", f"""
WITH {_CROWNS}, m AS (SELECT block, code, spp, avg(prop) AS m, var_pop(prop) AS v FROM profile
 WHERE cr_points > 0 AND length(code) = 2 GROUP BY ALL)
SELECT block, code, spp, round(m * (m * (1 - m) / v - 1), 6) AS alpha, round((1 - m) * (m * (1 - m) / v - 1), 6) AS beta FROM m""")
def _(t):
    rows = profile(t).filter((F.col("cr_points") > 0) & (F.length("code") == 2))
    return rounded(dist.beta_moments(rows, ["block", "code", "spp"], "prop"),
                   ["block", "code", "spp"], ["alpha", "beta"])


_WEEVIL = """SELECT s.code, s.block, s.plot, s.spp, count(*) AS n_trees, count(*) / 10 AS weevil_percent, count(*) * 10 * 2.47::DOUBLE AS n_trees_per_hectare
FROM live s JOIN (SELECT block, plot, tree, unnest([dam1, dam2, dam3]) AS v FROM stemform WHERE copy = 1) d USING (block, plot, tree)
WHERE s.spp = 'NS' AND s.code IN ('N', 'NW', 'NR', 'BN') AND {} GROUP BY ALL"""


def _weevil(t, **kw):
    form = clean.dedupe_by(t.stemform, ["block", "plot", "tree"], ["copy"])
    rows = t.live.filter((F.col("spp") == "NS") & F.col("code").isin("N", "NW", "NR", "BN"))
    rows = rows.join(form.drop("spp"), ["block", "plot", "tree"])
    return damage.weevil_incidence(rows, ["code", "block", "plot", "spp"], ["dam1", "dam2", "dam3"], **kw)


@query("weevil_exact_codes", "FM20 RS4", "live stemform", _WEEVIL.format("v IN ('FK/WV', 'WV')"))
def _(t):
    return _weevil(t)


@query("weevil_any_token", "FM20", "live stemform",
       _WEEVIL.format("list_contains(string_split(v, '/'), 'WV')"))
def _(t):
    return _weevil(t, token="WV")


_CLASSES = """SELECT {by}, CAST(greatest(ceil(dbh * 2.54::DOUBLE / 3), 1) AS INTEGER) AS dbh_class, count(*) * 24.7105::DOUBLE AS trees_ha
FROM live WHERE dbh * 2.54::DOUBLE <= (SELECT floor(max(dbh * 2.54::DOUBLE) / 3) * 3 FROM live) GROUP BY ALL"""


@query("diameter_distribution", "FM21 CLN12 DS5", "live", _CLASSES.format(by="code"))
def _(t):
    return stand.diameter_distribution(t.live, ["code"])


@query("diameter_distribution_species", "FM21 DS5", "live", _CLASSES.format(by="code, spp"))
def _(t):
    return stand.diameter_distribution(t.live, ["code", "spp"])


@query("mean_height_by_diameter", "FM22", "stems", """
SELECT spp, code, dbh, round(avg(final_ht), 6) AS avg_ht FROM stems WHERE code <> 'C' AND NOT (code = 'NR' AND spp = 'BS') GROUP BY ALL""")
def _(t):
    rows = t.stems.filter((F.col("code") != K.CONTROL) & ~((F.col("code") == "NR") & (F.col("spp") == "BS")))
    return rows.groupBy("spp", "code", "dbh").agg(F.round(F.avg("final_ht"), 6).alias("avg_ht"))


def mixture_plots(t):
    """Plot volumes with the plot's species shares of relative density."""
    plots = t.stems.groupBy("block", "plot", "uid", "code").agg(
        (F.sum("vol") * K.TREES_PER_ACRE * K.ACRES_PER_HA).alias("vol_ha"))
    shares = reshape.widen(stand.species_ratios(t.stems, ["uid"]), ["uid"], "spp", "rel_rd",
                           K.SPECIES, "_rd", agg=F.avg)
    return plots.filter(F.col("code") != K.CONTROL).join(shares, "uid", "left")


_YIELD = f"""{_RATIOS}, p AS (SELECT block, plot, uid, code, sum(vol) * 10 * 2.47::DOUBLE AS vol_ha FROM stems WHERE code <> 'C' GROUP BY ALL),
w AS (SELECT uid, coalesce(max(rel_rd) FILTER (spp = 'BS'), 0) AS bs, coalesce(max(rel_rd) FILTER (spp = 'NS'), 0) AS ns,
 coalesce(max(rel_rd) FILTER (spp = 'RS'), 0) AS rs, coalesce(max(rel_rd) FILTER (spp = 'WS'), 0) AS ws FROM r GROUP BY uid),
m AS (SELECT block, code, avg(vol_ha) AS v FROM p GROUP BY ALL),
d AS (SELECT block, max(v) FILTER (code = 'B') AS b, max(v) FILTER (code = 'N') AS n, max(v) FILTER (code = 'R') AS r, max(v) FILTER (code = 'W') AS w FROM m GROUP BY block)"""


@query("overyielding_weighted", "FM23 JN7 RS3", "stems", f"""
WITH {_YIELD} SELECT uid, code, round((bs * b + ns * n + rs * r + ws * d.w) / vol_ha, 6) AS oy
FROM p JOIN w USING (uid) JOIN d USING (block) WHERE length(code) = 2""")
def _(t):
    rows = yields.overyielding_weighted(mixture_plots(t), "vol_ha", [s + "_rd" for s in K.SPECIES])
    return rounded(rows, ["uid", "code"], ["oy"])


@query("overyielding_simple", "FM24", "stems", f"""
WITH {_YIELD}, x AS (SELECT m.code, m.v AS mix, (a.v + z.v) / 2 AS mono FROM m JOIN m a ON a.block = m.block AND a.code = substr(m.code, 1, 1)
 JOIN m z ON z.block = m.block AND z.code = substr(m.code, 2, 1) WHERE length(m.code) = 2)
SELECT code, round(avg(mix), 6) AS mean_mix, round(avg(mono), 6) AS mean_mono, round(stddev_samp(mix), 6) AS sd_mix,
 round(stddev_samp(mono), 6) AS sd_mono, round(avg(mix) / avg(mono), 6) AS overyielding FROM x GROUP BY code""")
def _(t):
    return rounded(yields.overyielding_simple(mixture_plots(t), "vol_ha"), ["code"],
                   ["mean_mix", "mean_mono", "sd_mix", "sd_mono", "overyielding"])


_BEST = "CASE WHEN code IN ('NW', 'NR', 'BN') THEN 'N' WHEN code IN ('BW', 'RW') THEN 'W' WHEN code = 'BR' THEN 'B' END"


@query("transgressive_overyielding", "FM25 JN7", "stems", f"""
WITH {_YIELD} SELECT p.uid, p.code, b.best, round(p.vol_ha / m.v, 6) AS toy FROM p JOIN (SELECT uid, {_BEST} AS best FROM p) b USING (uid)
LEFT JOIN m ON m.block = p.block AND m.code = b.best WHERE length(p.code) = 2""")
def _(t):
    return rounded(yields.transgressive(mixture_plots(t), "vol_ha"), ["uid", "code", "best"], ["toy"])


@query("transgressive_simple", "FM25", "stems", f"""
WITH {_YIELD}, x AS (SELECT y.code, y.best, y.v AS mix, m.v AS bv FROM (SELECT *, {_BEST} AS best FROM m) y JOIN m ON m.block = y.block AND m.code = y.best)
SELECT code, best, round(avg(mix), 6) AS mean_mix, round(avg(bv), 6) AS mean_best, round(stddev_samp(mix), 6) AS sd_mix,
 round(stddev_samp(bv), 6) AS sd_best, round(avg(mix) / avg(bv), 6) AS toy FROM x GROUP BY code, best""")
def _(t):
    return rounded(yields.transgressive_simple(mixture_plots(t), "vol_ha"), ["code", "best"],
                   ["mean_mix", "mean_best", "sd_mix", "sd_best", "toy"])
