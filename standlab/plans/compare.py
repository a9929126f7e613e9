"""Distributions, smoothing and treatment comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from standlab import constants as K
from standlab.functions import columns as C
from standlab.operators import compare, crown, dist, reshape, smooth
from standlab.plans.models import _FRAME, frame
from standlab.plans.registry import query
from standlab.plans.sql import f_tail, weibull
from standlab.plans.stand import profile, rounded
from standlab.session import cut_lineage, literal_table


# -- distributions --------------------------------------------------------------------------

def planted(t, df=None):
    pairs = literal_table(t.spark, K.MISPLANTED, "code string, spp string")
    return (t.stems if df is None else df).join(pairs, ["code", "spp"], "left_anti")


_PLANTED = "planted AS (SELECT s.* FROM stems s ANTI JOIN (VALUES " + ", ".join(
    f"('{code}', '{spp}')" for code, spp in K.MISPLANTED) + ") p(code, spp) ON s.code = p.code AND s.spp = p.spp)"


def _weibull_sql(col):
    return (f"WITH RECURSIVE {_PLANTED}, {weibull('fit', 'planted', 'block, code, spp', col)}\n"
            "SELECT block, code, spp, n, round(shape, 5) AS shape, round(scale, 5) AS scale FROM fit")


@query("weibull_diameter", "DS1 RS5 UD3 CLN3", "stems", _weibull_sql("dbh"))
def _(t):
    return rounded(dist.weibull_fit(planted(t), ["block", "code", "spp"], "dbh"), ["block", "code", "spp", "n"],
                   ["shape", "scale"], 5)


@query("weibull_height", "DS1 RS5 UD3", "stems", _weibull_sql("final_ht"))
def _(t):
    return rounded(dist.weibull_fit(planted(t), ["block", "code", "spp"], "final_ht"),
                   ["block", "code", "spp", "n"], ["shape", "scale"], 5)


@query("weibull_shape_by_species", "DS1 TC1 TC4", "stems", f"""
WITH RECURSIVE {_PLANTED}, {weibull("fit", "planted", "block, code, spp", "dbh")},
c AS (SELECT code, spp, count(*) AS n, avg(shape) AS m, var_pop(shape) * count(*) AS ss FROM fit WHERE length(code) = 2 GROUP BY ALL),
o AS (SELECT code, sum(n * m) / sum(n) AS centre FROM c GROUP BY code),
s AS (SELECT code, count(*) - 1 AS d1, CAST(sum(n) - count(*) AS BIGINT) AS d2, sum(n * (m - centre) ** 2) AS ssb, sum(ss) AS ssw FROM c JOIN o USING (code) GROUP BY code),
f AS (SELECT *, ssb / d1 / (ssw / d2) AS f FROM s WHERE d1 > 0 AND d2 > 0)
SELECT code, d1 AS df_between, d2 AS df_within, round(f, 5) AS f, round({f_tail("f", "d1", "d2")}, 5) AS p FROM f""")
def _(t):
    fits = dist.weibull_fit(planted(t), ["block", "code", "spp"], "dbh").filter(F.length("code") == 2)
    return rounded(compare.anova_oneway(fits, "shape", "spp", ["code"], p_value=True),
                   ["code", "df_between", "df_within"], ["f", "p"], 5)


@query("moment_description", "DS3", "stems site", f"""
WITH {_FRAME}, m AS (SELECT count(*) AS n, min(vol_ha) AS lo, max(vol_ha) AS hi, median(vol_ha) AS md, avg(vol_ha) AS mean, stddev_samp(vol_ha) AS sd FROM frame),
c AS (SELECT avg((vol_ha - mean) ** 2) AS m2, avg((vol_ha - mean) ** 3) AS m3, avg((vol_ha - mean) ** 4) AS m4 FROM frame, m)
SELECT n, round(lo, 6) AS "min", round(hi, 6) AS "max", round(md, 6) AS median, round(mean, 6) AS mean, round(sd, 6) AS sd,
 round(sqrt(n * (n - 1)) / (n - 2) * m3 / m2 ** 1.5, 6) AS skewness,
 round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (m2 * m2) - 3 * (n - 1)) + 3, 6) AS kurtosis FROM m, c""")
def _(t):
    return rounded(dist.describe(frame(t), "vol_ha"), ["n"],
                   ["min", "max", "median", "mean", "sd", "skewness", "kurtosis"])


@query("bootstrap_shape", "DS3")
def _(t):
    return rounded(dist.bootstrap_shape(frame(t), "vol_ha", "uid"), ["replicate"], ["skewness", "skew_sq", "kurtosis"])


_KDE = """s AS (SELECT {by}, count(*) AS n, 0.9::DOUBLE * least(stddev_samp(dbh), (quantile_cont(dbh, 0.75) - quantile_cont(dbh, 0.25)) / 1.34::DOUBLE) * pow(count(*), -0.2::DOUBLE) AS bw,
 min(dbh) AS lo0, max(dbh) AS hi0 FROM live GROUP BY ALL),
g AS (SELECT *, lo0 - 3 * bw AS lo, (hi0 - lo0 + 6 * bw) / 127 AS step FROM s),
a AS (SELECT {by}, floor((dbh - lo) / step) AS i, (dbh - lo) / step - floor((dbh - lo) / step) AS f FROM live JOIN g USING ({by})),
b AS (SELECT {by}, i, sum(w) AS w FROM (SELECT {by}, i, 1 - f AS w FROM a UNION ALL SELECT {by}, i + 1, f FROM a) GROUP BY ALL),
k AS (SELECT {by}, CAST(p.range AS INTEGER) AS point, lo + step * p.range AS x, n, sum(w * exp(-pow((p.range - i) * step / bw, 2) / 2)) / (n * bw * sqrt(2 * pi())) AS density
 FROM b JOIN g USING ({by}), range(128) p GROUP BY {by}, p.range, lo, step, n, bw)
SELECT {by}, point, round(x, 6) AS x, round(density, 8) AS density, round(density * n, 6) AS scaled FROM k"""


@query("diameter_density", "DS4", "live", "WITH " + _KDE.format(by="code"))
def _(t):
    rows = dist.kernel_density(t.live, ["code"], "dbh", 128, continuous=False)
    return rows.select("code", "point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"),
                       F.round("scaled", 6).alias("scaled"))


@query("diameter_density_species", "DS4 CLN11", "live", "WITH " + _KDE.format(by="code, spp"))
def _(t):
    rows = dist.kernel_density(t.live, ["code", "spp"], "dbh", 128, continuous=False)
    return rows.select("code", "spp", "point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"),
                       F.round("scaled", 6).alias("scaled"))


@query("diameter_histogram", "DS5 CLN12", "live", """
SELECT code, spp, 3.0::DOUBLE * trunc((dbh * 2.54::DOUBLE + 1.5) / 3) AS mark, count(*) * 24.7105::DOUBLE AS scaled_count FROM live WHERE length(code) = 2 GROUP BY ALL""")
def _(t):
    rows = t.live.filter(F.length("code") == 2).withColumn("cm", C.inches_to_cm("dbh"))
    return dist.histogram(rows, ["code", "spp"], "cm", 3.0, K.TREES_PER_ACRE * K.ACRES_PER_HA_FINE)


def height_points(t):
    rows = t.stems.filter(F.col("code") != K.CONTROL)
    return rows.groupBy("spp", "code", "dbh").agg(F.avg("final_ht").alias("avg_ht"))


@query("local_line", "DS6 FM22", "stems", """
WITH p AS (SELECT spp, code, dbh, avg(final_ht) AS y FROM stems WHERE code <> 'C' GROUP BY ALL),
d AS (SELECT a.spp, a.code, a.dbh, abs(b.dbh - a.dbh) AS d, b.dbh - a.dbh AS u, b.y,
 row_number() OVER (PARTITION BY a.spp, a.code, a.dbh ORDER BY abs(b.dbh - a.dbh)) AS r, count(*) OVER (PARTITION BY a.spp, a.code, a.dbh) AS m
 FROM p a JOIN p b ON a.spp = b.spp AND a.code = b.code),
h AS (SELECT spp, code, dbh, max(d) FILTER (r <= floor(0.75 * m + 0.00001)) AS h FROM d GROUP BY ALL),
w AS (SELECT d.*, pow(1 - pow(d / h, 3), 3) AS w FROM d JOIN h USING (spp, code, dbh) WHERE d < h),
s AS (SELECT spp, code, dbh, sum(w) AS w, sum(w * u) AS wu, sum(w * u * u) AS wuu, sum(w * y) AS wy, sum(w * u * y) AS wuy FROM w GROUP BY ALL)
SELECT spp, code, dbh, round((wy * wuu - wu * wuy) / (w * wuu - wu * wu), 6) AS smooth FROM s""")
def _(t):
    rows = smooth.local_regression(height_points(t), ["spp", "code"], "dbh", "avg_ht", degree=1)
    return rounded(rows, ["spp", "code", "dbh"], ["smooth"])


@query("local_curve", "DS6 FM22", "stems", """
WITH p AS (SELECT spp, code, dbh, avg(final_ht) AS y FROM stems WHERE code <> 'C' GROUP BY ALL),
d AS (SELECT a.spp, a.code, a.dbh, abs(b.dbh - a.dbh) AS d, b.dbh - a.dbh AS u, b.y,
 row_number() OVER (PARTITION BY a.spp, a.code, a.dbh ORDER BY abs(b.dbh - a.dbh)) AS r, count(*) OVER (PARTITION BY a.spp, a.code, a.dbh) AS m
 FROM p a JOIN p b ON a.spp = b.spp AND a.code = b.code),
h AS (SELECT spp, code, dbh, max(d) FILTER (r <= greatest(floor(0.75 * m + 0.00001), 1)) AS h FROM d GROUP BY ALL),
w AS (SELECT d.spp, d.code, d.dbh, y, CASE WHEN h > 0 THEN u / h ELSE 0 END AS u, CASE WHEN h > 0 THEN pow(1 - pow(d / h, 3), 3) ELSE 1 END AS w
 FROM d JOIN h USING (spp, code, dbh) WHERE d < h OR d = 0),
s AS (SELECT spp, code, dbh, count(*) AS c, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4,
 sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM w GROUP BY ALL)
SELECT spp, code, dbh, round(CASE WHEN c > 2 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
 / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))
 WHEN c = 2 THEN (t0 * s2 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 6) AS smooth FROM s""")
def _(t):
    rows = smooth.local_regression(height_points(t), ["spp", "code"], "dbh", "avg_ht")
    return rounded(rows, ["spp", "code", "dbh"], ["smooth"])


@query("smoothed_crown_profile", "DS7 UD2 AG7")
def _(t):
    average = crown.average_profile(profile(t).filter(F.length("code") == 2), ["code", "spp"])
    return rounded(smooth.smooth_profile(average, ["code", "spp"], "prop", "cr_points"), ["code", "spp", "prop"], ["smooth"], 5)


# -- treatment comparison -------------------------------------------------------------------

@query("anova_oneway", "TC1", "stems site", f"""
WITH {_FRAME}, c AS (SELECT code, count(*) AS n, avg(vol_ha) AS m, var_pop(vol_ha) * count(*) AS ss FROM frame GROUP BY code),
s AS (SELECT count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ss_between, sum(ss) AS ss_within FROM c)
SELECT df_between, df_within, round(ss_between, 3) AS ss_between, round(ss_within, 3) AS ss_within, round(ss_between / df_between, 4) AS ms_between,
 round(ss_within / df_within, 4) AS ms_within, round(ss_between / df_between / (ss_within / df_within), 6) AS f FROM s""")
def _(t):
    out = compare.anova_oneway(frame(t), "vol_ha", "code")
    digits = {"ss_between": 3, "ss_within": 3, "ms_between": 4, "ms_within": 4, "f": 6}
    return out.select("df_between", "df_within", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("anova_by_treatment", "TC1 UD5", "live", """
WITH c AS (SELECT code, spp, count(*) AS n, avg(dbh) AS m, var_pop(dbh) * count(*) AS ss FROM live WHERE length(code) = 2 GROUP BY ALL),
s AS (SELECT code, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum(ss) AS ssw FROM c GROUP BY code)
SELECT code, df_between, df_within, round(ssb / df_between / (ssw / df_within), 6) AS f FROM s""")
def _(t):
    out = compare.anova_oneway(t.live.filter(F.length("code") == 2), "dbh", "spp", ["code"])
    return rounded(out, ["code", "df_between", "df_within"], ["f"])


@query("anova_probabilities", "TC1 UD5", "live", f"""
WITH c AS (SELECT code, spp, count(*) AS n, avg(dbh) AS m, var_pop(dbh) * count(*) AS ss FROM live WHERE length(code) = 2 GROUP BY ALL),
o AS (SELECT code, sum(n * m) / sum(n) AS centre FROM c GROUP BY code),
s AS (SELECT code, count(*) - 1 AS d1, CAST(sum(n) - count(*) AS BIGINT) AS d2, sum(n * (m - centre) ** 2) AS ssb, sum(ss) AS ssw FROM c JOIN o USING (code) GROUP BY code),
f AS (SELECT *, ssb / d1 / (ssw / d2) AS f FROM s WHERE d1 > 0 AND d2 > 0)
SELECT code, d1 AS df_between, d2 AS df_within, round(f, 6) AS f, round({f_tail("f", "d1", "d2")}, 6) AS p FROM f""")
def _(t):
    out = compare.anova_oneway(t.live.filter(F.length("code") == 2), "dbh", "spp", ["code"], p_value=True)
    return rounded(out, ["code", "df_between", "df_within"], ["f", "p"])


def volume_types(t):
    """Plot volume and merchantable volume in long form."""
    merch = F.col("vol_ha") * (1 - 0.02 * F.pmod(F.col("plot"), F.lit(7)))
    rows = frame(t).select("uid", "code", F.col("vol_ha").alias("p_vol_ha"), merch.alias("merch_vol_ha"))
    return reshape.lengthen(rows, ["uid", "code"], ["p_vol_ha", "merch_vol_ha"], "volume_type", "volume")


_LONG = f"""{_FRAME}, v AS (SELECT uid, code, 'p_vol_ha' AS volume_type, vol_ha AS volume FROM frame
 UNION ALL SELECT uid, code, 'merch_vol_ha', vol_ha * (1 - 0.02::DOUBLE * (plot % 7)) FROM frame)"""


@query("anova_twoway", "TC2 RS4", "stems site", f"""
WITH {_LONG}, ce AS (SELECT code, volume_type, count(*) AS n, avg(volume) AS m, var_pop(volume) * count(*) AS ss FROM v GROUP BY ALL),
g AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, sum(ss) AS ss, count(*) AS k FROM ce),
a AS (SELECT count(*) - 1 AS df, sum(n * (ma - g.m) ** 2) AS ss FROM (SELECT code, sum(n) AS n, sum(n * m) / sum(n) AS ma FROM ce GROUP BY code) x(code, n, ma), (SELECT m FROM g) g),
b AS (SELECT count(*) - 1 AS df, sum(n * (mb - g.m) ** 2) AS ss FROM (SELECT volume_type, sum(n) AS n, sum(n * m) / sum(n) AS mb FROM ce GROUP BY volume_type) x(volume_type, n, mb), (SELECT m FROM g) g),
cs AS (SELECT sum(ce.n * (ce.m - g.m) ** 2) AS ss FROM ce, (SELECT m FROM g) g),
e AS (SELECT ss / (n - k) AS ms, n - k AS df, ss FROM g)
SELECT 'code' AS term, CAST(a.df AS INTEGER) AS df, round(a.ss, 3) AS ss, round(a.ss / a.df / e.ms, 5) AS f FROM a, e
UNION ALL SELECT 'volume_type', CAST(b.df AS INTEGER), round(b.ss, 3), round(b.ss / b.df / e.ms, 5) FROM b, e
UNION ALL SELECT 'code:volume_type', CAST(a.df * b.df AS INTEGER), round(cs.ss - a.ss - b.ss, 3), round((cs.ss - a.ss - b.ss) / (a.df * b.df) / e.ms, 5) FROM a, b, cs, e
UNION ALL SELECT 'residual', CAST(e.df AS INTEGER), round(e.ss, 3), NULL FROM e""")
def _(t):
    out = compare.anova_twoway(volume_types(t), "volume", "code", "volume_type")
    return out.select("term", "df", F.round("ss", 3).alias("ss"), F.round("f", 5).alias("f"))


@query("volume_summary", "RS4 AG3 CLN16", "stems site", f"""
WITH {_LONG} SELECT code, volume_type, CAST(CASE volume_type WHEN 'p_vol_ha' THEN 1 ELSE 2 END AS BIGINT) AS type_level, round(avg(volume), 6) AS mean_volume,
 round(stddev_samp(volume) / sqrt(count(*)), 6) AS se_volume FROM v GROUP BY code, volume_type""")
def _(t):
    level = C.level_order("volume_type", ["p_vol_ha", "merch_vol_ha"])
    return volume_types(t).groupBy("code", "volume_type", level.alias("type_level")).agg(
        F.round(F.avg("volume"), 6).alias("mean_volume"), F.round(C.std_error("volume"), 6).alias("se_volume"))


@query("marginal_means", "TC3", "live", """
SELECT code, round(avg(m), 6) AS emmean, CAST(sum(n) AS BIGINT) AS n FROM (SELECT code, block, spp, avg(dbh) AS m, count(*) AS n FROM live GROUP BY ALL) GROUP BY code""")
def _(t):
    return rounded(compare.marginal_means(t.live, "dbh", ["code"], ["block", "spp"]), ["code", "n"], ["emmean"])


_PAIRS = """c AS (SELECT {by} {g} AS g, count(*) AS n, avg({y}) AS m, var_pop({y}) * count(*) AS ss FROM {src} GROUP BY ALL),
e AS (SELECT {by} sum(ss) / (sum(n) - count(*)) AS mse, CAST(sum(n) - count(*) AS BIGINT) AS df FROM c {grp})
SELECT {a} a.g AS level_a, b.g AS level_b, round(a.m - b.m, 6) AS difference, round(sqrt(mse * (1.0 / a.n + 1.0 / b.n)), 6) AS se, df,
 round((a.m - b.m) / sqrt(mse * (1.0 / a.n + 1.0 / b.n)), 6) AS t, round(abs(a.m - b.m) / sqrt(mse * (1.0 / a.n + 1.0 / b.n)) * sqrt(2), 6) AS q
FROM c a JOIN c b ON {on} a.g < b.g JOIN e ON {one}"""


@query("treatment_pairs", "TC4", "stems site", f"WITH {_FRAME}, " + _PAIRS.format(
    by="", g="code", y="vol_ha", src="frame", grp="", a="", on="", one="true"))
def _(t):
    rows = compare.all_pairs(frame(t), "vol_ha", "code", p_value=False)
    return rounded(rows, ["level_a", "level_b", "df"], ["difference", "se", "t", "q"])


@query("species_pairs_by_treatment", "TC4 TC5 UD5", "live", "WITH " + _PAIRS.format(
    by="code,", g="spp", y="dbh", src="live", grp="GROUP BY code", a="a.code,", on="a.code = b.code AND", one="e.code = a.code"))
def _(t):
    rows = compare.all_pairs(t.live, "dbh", "spp", ["code"], p_value=False)
    return rounded(rows, ["code", "level_a", "level_b", "df"], ["difference", "se", "t", "q"])


@query("treatment_pairs_adjusted", "TC4 TC5")
def _(t):
    rows = compare.all_pairs(frame(t), "vol_ha", "code")
    return rounded(rows, ["level_a", "level_b", "df"], ["difference", "t", "q", "p_tukey", "p_bonferroni"])


@query("species_pairs_adjusted", "TC5 UD5")
def _(t):
    rows = compare.all_pairs(t.live, "dbh", "spp", ["code"])
    return rounded(rows, ["code", "level_a", "level_b", "df"], ["difference", "t", "q", "p_tukey", "p_bonferroni"])


@query("beta_shape_contrasts", "TC5 DS2 MD2")
def _(t):
    rows = profile(t).filter((F.col("cr_points") > 0) & (F.length("code") == 2))
    fits = cut_lineage(dist.beta_moments(rows, ["block", "code", "spp"], "prop"))  # the contrasts read them twice
    out = compare.model_contrasts(fits, "alpha", "code", K.MIXED, {"spp": K.SPECIES})
    return rounded(out, ["level_a", "level_b", "df"], ["difference", "se", "t", "p_bonferroni"], 5)


@query("welch_test", "TC6", "live", """
SELECT code, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 6) AS df FROM (
 SELECT code, avg(dbh) FILTER (spp = 'BS') AS ma, avg(dbh) FILTER (spp = 'RS') AS mb, var_samp(dbh) FILTER (spp = 'BS') AS va, var_samp(dbh) FILTER (spp = 'RS') AS vb,
  count(*) FILTER (spp = 'BS') AS na, count(*) FILTER (spp = 'RS') AS nb FROM live WHERE code IN ('BR', 'C') GROUP BY code)""")
def _(t):
    rows = t.live.filter(F.col("code").isin("BR", K.CONTROL))
    return rounded(compare.welch(rows, "dbh", "spp", "BS", "RS", ["code"]), ["code"], ["t", "df"])
