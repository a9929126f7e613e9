"""Regression, curve, mixed and count models."""

from __future__ import annotations

from pyspark.sql import functions as F

from standlab import constants as K
from standlab.functions import columns as C
from standlab.operators import clean, counts, damage, gram, mixed, nls, stand, subsets, windows
from standlab.operators.reshape import widen
from standlab.plans.registry import query
from standlab.plans.sql import crossproducts, matrix, sweep
from standlab.plans.stand import rounded
from standlab.session import cut_lineage, literal_table

_FRAME = """frame AS (SELECT p.*, s.dep, s.slope, s.swi, s.rad, s.elevation, s.winds, s.ph FROM (
 SELECT block, plot, uid, code, sum(dbh * dbh) * 0.005454::DOUBLE * 10 AS bapa, count(*) * 10.0::DOUBLE AS tpa, sqrt(sum(dbh * dbh) / count(*)) AS qmd,
  sum(dbh * dbh) * 0.005454::DOUBLE * 10 / sqrt(sqrt(sum(dbh * dbh) / count(*))) AS rd, sum(vol) * 10 * 2.47::DOUBLE AS vol_ha
 FROM stems WHERE code <> 'C' GROUP BY ALL) p JOIN site s USING (uid))"""


def frame(t):
    """Plot metrics beside site covariates, controls left out."""
    plots = stand.plot_summary(t.stems.filter(F.col("code") != K.CONTROL))
    return plots.join(t.site.drop("block", "plot"), "uid")


# -- linear models --------------------------------------------------------------------------

@query("ols_by_species", "MD1", "live", """
SELECT spp, n, round(regr[1], 6) AS intercept, round(regr[2], 6) AS slope, round(r2, 6) AS r2,
 round(sqrt((syy - regr[2] * sxy) / (n - 2) / sxx), 8) AS se_slope FROM (
 SELECT spp, count(*) AS n, [regr_intercept(ht, dbh), regr_slope(ht, dbh)] AS regr, regr_r2(ht, dbh) AS r2, regr_sxx(ht, dbh) AS sxx,
  regr_sxy(ht, dbh) AS sxy, regr_syy(ht, dbh) AS syy FROM live WHERE ht IS NOT NULL GROUP BY spp)""")
def _(t):
    fits = gram.ols(t.live, "ht", ["dbh"], ["spp"])
    return fits.select("spp", "n", F.round(F.get("estimate", F.lit(0)), 6).alias("intercept"),
                       F.round(F.get("estimate", F.lit(1)), 6).alias("slope"), F.round("r2", 6).alias("r2"),
                       F.round(F.get("se", F.lit(1)), 8).alias("se_slope"))


@query("ols_two_terms", "MD1", "stems site", f"""
WITH {_FRAME}, m AS (SELECT count(*) AS n, avg(rd) AS ma, avg(dep) AS mb, avg(vol_ha) AS my, var_pop(rd) AS aa, covar_pop(rd, dep) AS ab, var_pop(dep) AS bb,
 covar_pop(rd, vol_ha) AS ay, covar_pop(dep, vol_ha) AS byy, var_pop(vol_ha) AS yy FROM frame),
s AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS b1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m)
SELECT n, round(my - b1 * ma - b2 * mb, 6) AS intercept, round(b1, 6) AS rd, round(b2, 6) AS dep, round((b1 * ay + b2 * byy) / yy, 6) AS r2 FROM s""")
def _(t):
    fits = gram.ols(frame(t), "vol_ha", ["rd", "dep"])
    names = ["intercept", "rd", "dep"]
    return fits.select("n", *[F.round(F.get("estimate", F.lit(i)), 6).alias(c) for i, c in enumerate(names)],
                       F.round("r2", 6).alias("r2"))


_SPP = [f"spp_{c}" for c in K.SPECIES[1:]]


def _ols_sql(rows: str, names: list[str], z: str, y: str) -> str:
    """CTEs of a regression: ``f`` has the swept matrix, n and the centred total of the response."""
    size = len(names) + 2
    return f"""rw AS ({rows}), z AS (SELECT [1, {z}, {y}]::DOUBLE[] AS z FROM rw),
{crossproducts("cp", "z", size)},
{matrix("cm", "cp")},
{sweep("sw", "cm", size, size - 1)},
f AS (SELECT sw.m, cm.m AS raw, cm.m[1][1] AS n, sw.m[{size}][{size}] AS sse, cm.m[{size}][{size}] - cm.m[1][{size}] ** 2 / cm.m[1][1] AS sst,
 {["(Intercept)", *names]!r} AS terms FROM sw, cm)"""


def _terms_sql(size: int) -> str:
    return (f"SELECT terms[i] AS term, round(m[i][{size}], 6) AS estimate, round(sqrt(m[i][i] * sse / (n - {size - 1})), 6) AS se "
            f"FROM f, range(1, {size}) t(i)")


_SPP_Z = ", ".join(f"(spp = '{c}')::INT" for c in K.SPECIES[1:])
_CODE_D = ", ".join(f"(code = '{c}')::INT" for c in (K.PURE + K.MIXED)[1:])


@query("ols_factors", "MD2 MD1", "stems site", f"""
WITH RECURSIVE {_ols_sql("SELECT hcb, final_ht, dbh, vpdmax, spp FROM stems JOIN site USING (uid) WHERE hcb IS NOT NULL",
                         ["final_ht", "dbh", "vpdmax", *_SPP], f"final_ht, dbh, vpdmax, {_SPP_Z}", "hcb")} {_terms_sql(8)}""")
def _(t):
    rows, names = gram.dummies(t.stems.join(t.site.select("uid", "vpdmax"), "uid"), {"spp": K.SPECIES})
    fits = gram.ols(rows, "hcb", ["final_ht", "dbh", "vpdmax", *names])
    return rounded(gram.coefficients(fits), ["term"], ["estimate", "se"])


@query("ols_interaction", "MD2", "stems site", f"""
WITH RECURSIVE {_FRAME}, {_ols_sql("SELECT * FROM frame", ["rd", "dep", *[f"code_{c}" for c in (K.PURE + K.MIXED)[1:]],
                                   *[f"dep_x_code_{c}" for c in (K.PURE + K.MIXED)[1:]]],
                                   f"rd, dep, {_CODE_D}, " + ", ".join(f"(code = '{c}')::INT * dep" for c in (K.PURE + K.MIXED)[1:]), "vol_ha")}
{_terms_sql(22)}""")
def _(t):
    rows, names = gram.dummies(frame(t), {"code": K.PURE + K.MIXED}, [("dep", "code")])
    fits = gram.ols(rows, "vol_ha", ["rd", "dep", *names])
    return rounded(gram.coefficients(fits), ["term"], ["estimate", "se"])


@query("ols_logs", "MD2", "stems", f"""
WITH RECURSIVE {_ols_sql("SELECT * FROM stems WHERE hcb IS NOT NULL", ["dbh", "final_ht", "hdr", "log_ccf", *_SPP],
                         f"dbh, final_ht, final_ht / dbh, ln(pi() * pow(cw / 2, 2) / 435.6 + 0.1), {_SPP_Z}", "hcb")}
SELECT n::BIGINT AS n, round(1 - sse / sst, 6) AS r2, round(1 - sse / sst * (n - 1) / (n - 8), 6) AS adj_r2, round(sqrt(sse / n), 6) AS rmse,
 round(n * (ln(2 * pi() * sse / n) + 1) + 18, 3) AS aic FROM f""")
def _(t):
    rows, names = gram.dummies(t.stems.withColumns({
        "hdr": C.ratio("final_ht", "dbh"), "log_ccf": F.log(C.crown_area("cw") / 435.6 + 0.1)}),
        {"spp": K.SPECIES})
    fits = gram.ols(rows, "hcb", ["dbh", "final_ht", "hdr", "log_ccf", *names])
    return rounded(fits.withColumn("aic", F.round("aic", 3)), ["n", "aic"], ["r2", "adj_r2", "rmse"])


@query("predicted_heights", "MD3", "live", """
WITH f AS (SELECT spp, regr_intercept(ht, dbh) AS a, regr_slope(ht, dbh) AS b FROM live GROUP BY spp)
SELECT uid, tree, round(a + b * dbh, 6) AS ht_line FROM live JOIN f USING (spp)""")
def _(t):
    fits = gram.ols(t.live, "ht", ["dbh"], ["spp"])
    return rounded(gram.predict(t.live, fits, ["dbh"], ["spp"], "ht_line"), ["uid", "tree"], ["ht_line"])


@query("fit_statistics", "MD4", "stems", """
WITH r AS (SELECT ht, ht_fit AS p, ht - ht_fit AS e FROM stems WHERE ht IS NOT NULL),
s AS (SELECT count(*) AS n, avg(e) AS mb, avg(abs(e)) AS mab, sum(e * e) AS sse, var_pop(ht) * count(*) AS sst FROM r)
SELECT n, round(mb, 8) AS mb, round(mab, 8) AS mab, round(sse, 4) AS sse, round(sst, 4) AS sst, round(1 - sse / sst, 8) AS rsq,
 round(1 - (sse / sst) * (n - 1) / (n - 2 - 1), 8) AS adj_rsq, round(sqrt(sse / n), 8) AS rmse, round(-n / 2 * (ln(2 * pi() * sse / n) + 1), 4) AS loglik,
 round(n * (ln(2 * pi() * sse / n) + 1) + 6, 4) AS aic FROM s""")
def _(t):
    s = gram.fit_stats(t.stems, "ht", "ht_fit", 2)
    return s.select("n", *[F.round(c, 8).alias(c) for c in ["mb", "mab", "rsq", "adj_rsq", "rmse"]],
                    *[F.round(c, 4).alias(c) for c in ["sse", "sst", "loglik", "aic"]])


@query("vif_pair", "MD5", "stems site", f"""
WITH {_FRAME} SELECT round(1 / (1 - corr(rd, qmd) * corr(rd, qmd)), 6) AS vif FROM frame""")
def _(t):
    return gram.vif_pair(frame(t), "rd", "qmd").withColumn("vif", F.round("vif", 6))


@query("vif_full", "MD5", "stems site", f"""
WITH RECURSIVE {_FRAME}, {_ols_sql("SELECT * FROM frame", ["rd", "qmd", "tpa", "dep", "slope"], "rd, qmd, tpa, dep, slope", "vol_ha")}
SELECT terms[i] AS term, round(m[i][i] * (raw[i][i] - raw[1][i] ** 2 / n), 6) AS vif FROM f, range(2, 7) t(i)""")
def _(t):
    values = gram.vif(frame(t), ["rd", "qmd", "tpa", "dep", "slope"])
    return literal_table(t.spark, [(k, round(v, 6)) for k, v in values.items()], "term string, vif double")


XS13 = ["bapa", "tpa", "qmd", "rd", "ccf", "lai", "dep", "elevation", "winds", "ph", "swi", "rad", "slope"]
_WIDE = """wide AS (SELECT p.*, bapa / sqrt(qmd) AS rd, s.dep, s.elevation, s.winds, s.ph, s.swi, s.rad, s.slope FROM (
 SELECT uid, sum(dbh * dbh) * 0.005454::DOUBLE * 10 AS bapa, count(*) * 10.0::DOUBLE AS tpa, sqrt(sum(dbh * dbh) / count(*)) AS qmd,
  sum(pi() * pow(cw / 2, 2) * 10) / 43560 * 100 AS ccf, coalesce(avg(lai), 0) AS lai, sum(vol) * 10 * 2.47::DOUBLE AS vol_ha
 FROM stems WHERE code <> 'C' GROUP BY uid) p JOIN site s USING (uid))"""
_NEXT = ("CASE WHEN i = c AND j = c THEN 1 / m[c][c] WHEN i = c THEN m[i][j] / m[c][c] WHEN j = c THEN -m[i][j] / m[c][c] "
         "ELSE m[i][j] - m[i][c] * m[c][j] / m[c][c] END")


@query("best_subsets", "MD6", "stems site", f"""
WITH RECURSIVE {_WIDE}, mu AS (SELECT [{", ".join(f"avg({c})" for c in [*XS13, "vol_ha"])}] AS mu FROM wide),
z AS (SELECT list_transform(list_zip([{", ".join([*XS13, "vol_ha"])}], mu), lambda p: p[1] - p[2]) AS z FROM wide, mu),
{crossproducts("cp", "z", 14)},
{matrix("cm", "cp")},
tree AS (SELECT 0 AS size, 0 AS last, ''::VARCHAR AS terms, m FROM cm UNION ALL
 SELECT size + 1, c::INT, terms || CASE WHEN size > 0 THEN '+' ELSE '' END || {XS13!r}[c],
  list_transform(range(1, 15), lambda i: list_transform(range(1, 15), lambda j: {_NEXT}))
 FROM tree, range(1, 14) t(c) WHERE c > last AND size < 8)
SELECT size, arg_min(terms, m[14][14]) AS terms, round(min(m[14][14]), 4) AS rss, round(1 - min(m[14][14]) / (SELECT m[14][14] FROM cm), 4) AS r2
FROM tree WHERE size > 0 GROUP BY size""")
def _(t):
    return rounded(subsets.best_subsets(frame(t).fillna(0, subset=["lai"]), "vol_ha", XS13, 8), ["size", "terms"], ["rss", "r2"], 4)


SITE_TERMS = ["dep", "elevation", "winds", "ph", "swi", "rad", "slope", "tmax", "vpdmax", "ppt"]


@query("best_subsets_wide", "MD6")
def _(t):
    """48 candidates: plot metrics, species shares of density and volume, site covariates and squares."""
    shares = stand.species_ratios(t.stems, ["uid"])
    rows = frame(t).fillna(0, subset=["lai"])
    names = ["bapa", "tpa", "qmd", "rd", "ccf", "lai", "sdi", *SITE_TERMS]
    for value, suffix in (("rel_rd", "_rd"), ("rel_vol", "_vol")):
        if value in shares.columns:
            rows = rows.join(widen(shares, ["uid"], "spp", value, K.SPECIES, suffix, agg=F.avg), "uid")
            names += [f"{spp}{suffix}" for spp in K.SPECIES]
    squares = [*SITE_TERMS, "bapa", "tpa", "qmd", "rd", "ccf", "lai", "sdi"]
    rows = rows.withColumns({f"{c}_2": F.col(c) * F.col(c) for c in squares} | {
        f"{c}_rd": F.col(c) * F.col("rd") for c in SITE_TERMS[:6]})
    names = [*names, *[f"{c}_2" for c in squares], *[f"{c}_rd" for c in SITE_TERMS[:6]]][:48]
    rows = cut_lineage(rows.select("vol_ha", *names))  # one row per plot; the search reads it twice
    return rounded(subsets.best_subsets(rows, "vol_ha", names, 8), ["size", "terms"], ["rss", "r2"], 4)


_BOXCOX = f"""{_FRAME}, g AS (SELECT -2 + 4.0::DOUBLE * range / 99 AS exponent FROM range(100)),
b AS (SELECT exponent, -count(*) / 2 * ln(var_pop((pow(vol_ha, exponent) - 1) / exponent)) + (exponent - 1) * sum(ln(vol_ha)) AS loglik FROM frame, g GROUP BY exponent)"""


@query("boxcox_profile", "MD7", "stems site", f"WITH {_BOXCOX} SELECT round(exponent, 8) AS exponent, round(loglik, 4) AS loglik FROM b")
def _(t):
    rows = gram.boxcox_profile(frame(t), "vol_ha")
    return rows.select(F.round("exponent", 8).alias("exponent"), F.round("loglik", 4).alias("loglik"))


@query("boxcox_best", "MD7", "stems site", f"WITH {_BOXCOX} SELECT round(max_by(exponent, loglik), 8) AS exponent FROM b")
def _(t):
    return gram.boxcox_best(frame(t), "vol_ha").withColumn("exponent", F.round("exponent", 8))


@query("variance_power", "MD12", "live", """
WITH r AS (SELECT ln(ht) AS y, ln(dbh + 1) AS x, dbh, t.range / 20.0::DOUBLE - 0.5::DOUBLE AS theta FROM live, range(21) t WHERE ht IS NOT NULL AND dbh > 0),
s AS (SELECT theta, count(*) AS n, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy, sum(w * y * y) AS wyy, sum(ln(dbh)) AS sl
 FROM (SELECT *, pow(dbh, -2 * theta) AS w FROM r) GROUP BY theta),
f AS (SELECT *, (wxy - wx * wy / w) / (wxx - wx * wx / w) AS b FROM s)
SELECT theta, round((wy - b * wx) / w, 6) AS intercept, round(b, 6) AS slope,
 round(-n / 2 * (ln(2 * pi() * (wyy - wy * wy / w - b * (wxy - wx * wy / w)) / n) + 1) - theta * sl, 4) AS loglik FROM f""")
def _(t):
    rows = t.live.withColumns({"y": F.log("ht"), "x": F.log(F.col("dbh") + 1)})
    grid = [i / 20.0 - 0.5 for i in range(21)]
    fits = gram.variance_power(rows, "y", "x", "dbh", grid)
    return fits.select("theta", F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"),
                       F.round("loglik", 4).alias("loglik"))


_LOGFIT = """f AS (SELECT count(*) AS n, regr_intercept(ln(ht), ln(dbh + 1)) AS a, regr_slope(ln(ht), ln(dbh + 1)) AS b,
 (regr_syy(ln(ht), ln(dbh + 1)) - regr_slope(ln(ht), ln(dbh + 1)) * regr_sxy(ln(ht), ln(dbh + 1))) AS sse FROM live WHERE ht IS NOT NULL)"""


@query("back_transformed_height", "MD13", "live", f"""
WITH {_LOGFIT} SELECT uid, tree, round(exp(a + b * ln(dbh + 1)), 6) AS naive, round(exp(a + b * ln(dbh + 1) + sse / (n - 2) / 2), 6) AS corrected FROM live, f""")
def _(t):
    rows = t.live.withColumns({"y": F.log("ht"), "x": F.log(F.col("dbh") + 1)})
    fit = gram.ols(rows, "y", ["x"]).first()
    a, b = (F.lit(float(v)) for v in fit["estimate"])
    sigma = F.lit(float(fit["sigma2"]) ** 0.5)
    return rows.select("uid", "tree", F.round(F.exp(a + b * F.col("x")), 6).alias("naive"),
                       F.round(gram.log_height_prediction(a, b, F.col("x"), sigma), 6).alias("corrected"))


@query("furnival_index", "MD16", "live", f"""
WITH {_LOGFIT} SELECT round(any_value(sqrt(sse / (n - 2))) / exp(avg(ln(1 / ht))), 6) AS fit_index FROM live, f WHERE ht IS NOT NULL""")
def _(t):
    rows = t.live.withColumns({"y": F.log("ht"), "x": F.log(F.col("dbh") + 1)})
    sigma = float(gram.ols(rows, "y", ["x"]).first()["sigma2"]) ** 0.5
    return gram.fit_index(t.live, "ht", sigma).withColumn("fit_index", F.round("fit_index", 6))


# -- curves ---------------------------------------------------------------------------------

@query("wykoff_linearised", "MD8", "live", """
SELECT count(*) AS n, round(regr_intercept(ln(ht - 4.5), 1 / dbh), 6) AS a, round(regr_slope(ln(ht - 4.5), 1 / dbh), 6) AS b,
 round(regr_r2(ln(ht - 4.5), 1 / dbh), 6) AS r2 FROM live WHERE ht > 4.5""")
def _(t):
    return rounded(nls.linearised(t.live, "ht", 1 / F.col("dbh")), ["n"], ["a", "b", "r2"])


@query("power_linearised", "MD8", "live", """
SELECT count(*) AS n, round(exp(regr_intercept(ln(ht - 4.5), ln(dbh))), 6) AS a, round(regr_slope(ln(ht - 4.5), ln(dbh)), 6) AS b,
 round(regr_r2(ln(ht - 4.5), ln(dbh)), 6) AS r2 FROM live WHERE ht > 4.5""")
def _(t):
    rows = nls.linearised(t.live, "ht", F.log("dbh")).withColumn("a", F.exp("a"))
    return rounded(rows, ["n"], ["a", "b", "r2"])


@query("height_curve_by_species_linear", "MD9", "live", """
SELECT spp, count(*) AS n, round(regr_intercept(ln(ht - 4.5), 1 / (dbh + 1)), 6) AS a, round(regr_slope(ln(ht - 4.5), 1 / (dbh + 1)), 6) AS b,
 round(regr_r2(ln(ht - 4.5), 1 / (dbh + 1)), 6) AS r2 FROM live WHERE ht > 4.5 GROUP BY spp""")
def _(t):
    rows = nls.linearised(t.live, "ht", 1 / (F.col("dbh") + 1), ["spp"])
    return rounded(rows, ["spp", "n"], ["a", "b", "r2"])


@query("height_curves_six_forms", "MD8")
def _(t):
    fits = nls.fit_forms(t.live, "ht", {f: (f, ["dbh"]) for f in nls.HEIGHT_FORMS})
    return rounded(nls.parameter_table(t.spark, fits), ["form", "rank", "term"], ["estimate", "se", "sse", "aic"], 5)


@query("height_curve_by_group", "MD8 RS5 UD3")
def _(t):
    fits = nls.nls_by(t.live, "ht", "wykoff", ["dbh"], ["code", "spp"])
    return fits.select("code", "spp", "n", F.round(F.get("estimate", F.lit(0)), 5).alias("b0"),
                       F.round(F.get("estimate", F.lit(1)), 5).alias("b1"), F.round("sse", 4).alias("sse"))


@query("two_stage_height", "MD9 JN5")
def _(t):
    population, groups = mixed.two_stage_height(t.live, ["spp"])
    scored = mixed.predict_two_stage(t.live, population, groups, ["spp"])
    stats = gram.fit_stats(scored, "ht", "ht_fit", 2, ["spp"]).select("spp", "mb", "rsq")
    table = groups.withColumns({"pop_a": F.lit(population["a"]), "pop_b": F.lit(population["b"])})
    return rounded(table.join(stats, "spp"), ["spp", "n"], ["a_fit", "b_fit", "a", "b", "pop_a", "pop_b", "mb", "rsq"], 5)


@query("crown_base_curves", "MD14")
def _(t):
    rows = t.stems.filter("hcb > 0 AND hcb < final_ht").withColumns({
        "lcr": C.live_crown_ratio("final_ht", "hcb"), "ccf": C.crown_area("cw") / K.SQFT_PER_ACRE * 100})
    line = gram.ols(rows, "hcb", ["dbh", "final_ht"]).first()["estimate"]
    rows = rows.withColumn("score", gram.linear_predictor(line[0], {"dbh": line[1], "final_ht": line[2]}))
    fits = nls.fit_forms(rows, "hcb", {
        "base_logistic": ("base_logistic", ["final_ht", "dbh"]),
        "base_logistic_short": ("base_logistic_short", ["final_ht", "dbh"])}, collapse=False)
    branch = rows.withColumn("llb", 0.4 * F.col("hcb"))
    fits.update(nls.fit_forms(branch, "llb", {"base_score": ("base_score", ["final_ht", "score"])}, collapse=False))
    fits.update(nls.fit_forms(rows, "lcr", {"crown_ratio": ("crown_ratio", ["ccf"])}))
    return rounded(nls.parameter_table(t.spark, fits), ["form", "term"], ["estimate", "se", "sse"], 5)


@query("crown_base_filled", "MD14 FM18 CLN15")
def _(t):
    rows = t.stems.withColumn("ccf", C.crown_area("cw") / K.SQFT_PER_ACRE * 100)
    seen = rows.filter("hcb > 0").withColumn("lcr", C.live_crown_ratio("final_ht", "hcb"))
    fit = nls.nls(seen, "lcr", "crown_ratio", ["ccf"])
    est = F.array(*[F.lit(float(v)) for v in fit["estimate"]])
    rows = rows.withColumn("_e", est).withColumn("fit_lcr", nls.curve("crown_ratio", "_e", ["ccf"]))
    rows = rows.withColumn("fit_hcb", C.crown_base("final_ht", F.col("fit_lcr")))
    gap = F.col("hcb").isNull() | (F.col("hcb") < 1)
    rows = clean.impute(rows, "hcb", "fit_hcb", "hcb_filled", "imputed", missing=gap)
    return rounded(rows, ["uid", "tree", "imputed"], ["hcb_filled"], 5)


@query("weibull_class_curve", "DS8 CLN12")
def _(t):
    top = t.live.agg(F.max("dbh")).scalar()
    classed = t.live.withColumn("dbh1", C.bin_cut("dbh", 1.0, top, right=False)).filter("dbh1 IS NOT NULL")
    counts_ = classed.groupBy("spp", "code", "dbh1").agg(F.count(F.lit(1)).alias("n"))
    rows = windows.with_group_total(counts_, ["spp", "code"], total=F.sum("n")).withColumns({
        "share": F.col("n") / F.col("total"), "mid": F.col("dbh1") - 0.5})
    fits = nls.nls_by(rows, "share", "weibull_density", ["mid"], ["spp", "code"], collapse=False)
    return fits.select("spp", "code", F.round(F.get("estimate", F.lit(0)), 4).alias("scale"),
                       F.round(F.get("estimate", F.lit(1)), 4).alias("shape"))


# -- mixed models ---------------------------------------------------------------------------

@query("variance_components", "MD10", "stems site", f"""
WITH {_FRAME}, l AS (SELECT code, count(*) AS n, avg(vol_ha) AS m, var_pop(vol_ha) AS v FROM frame GROUP BY code),
s AS (SELECT count(*) AS k, sum(n)::DOUBLE AS nn, sum(n * m) / sum(n) AS mean, sum(n * v) AS ssw, sum(n * n)::DOUBLE AS n2 FROM l),
b AS (SELECT k, nn, mean, n2, (SELECT sum(n * (m - mean) * (m - mean)) FROM l, s) / (k - 1) AS msb, ssw / (nn - k) AS msw FROM s)
SELECT k AS groups, round(mean, 6) AS mean, round(msb, 4) AS msb, round(msw, 4) AS msw, round(greatest((msb - msw) / ((nn - n2 / nn) / (k - 1)), 0), 6) AS var_group,
 round(msw, 4) AS var_error FROM b""")
def _(t):
    out = mixed.variance_components(frame(t), "vol_ha", "code")
    return out.select("groups", *[F.round(c, d).alias(c) for c, d in
                                  {"mean": 6, "msb": 4, "msw": 4, "var_group": 6, "var_error": 4}.items()])


def mixture_model(t):
    shares = widen(stand.species_ratios(t.stems, ["uid"]), ["uid"], "spp", "rel_rd", K.SPECIES, "_rd", agg=F.avg)
    rows = frame(t).join(shares, "uid").persist()
    return rows, mixed.random_intercept(rows, "vol_ha", ["rd", "NS_rd", "dep"], ["block"])


@query("random_block_model", "MD10")
def _(t):
    rows, fit = mixture_model(t)
    rows.unpersist()
    return rounded(fit.fixed(t.spark), ["term"], ["estimate", "se"], 5)


@query("random_plot_effects", "MD10 JN5")
def _(t):
    fit = mixed.random_intercept(t.live.withColumn("x", 1 / (F.col("dbh") + 1)), "ht", ["x"], ["uid"])
    return rounded(fit.effects, ["uid", "n"], ["effect"], 5)


CODES = K.PURE + K.MIXED
RATIOS = [0.0] + [10.0 ** (i / 4 - 3) for i in range(21)]

_CODE_Z = "[1, " + ", ".join(f"(code = '{c}')::INT" for c in CODES[1:]) + ", vol_ha]"
_BLOCKS = f"""{_FRAME}, z AS (SELECT block, {_CODE_Z}::DOUBLE[] AS z FROM frame),
{crossproducts("bc", "z", 11, "block, ")},
gr AS (SELECT unnest({RATIOS!r}::DOUBLE[]) AS ratio),
bl AS (SELECT block, max(v) FILTER (i = 1 AND j = 1) AS n, list(v ORDER BY j) FILTER (i = 1) AS s FROM bc GROUP BY block),
vc AS (SELECT ratio, i, j, sum(v - ratio / (1 + ratio * n) * s[i] * s[j]) AS v FROM bc JOIN bl USING (block), gr GROUP BY ratio, i, j),
{matrix("vm", "vc", "ratio, ")},
{sweep("sw", "vm", 11, 10, "ratio, ")},
fit AS (SELECT ratio, m, m[11][11] / (nn - 10) AS s2, nn, nb, -0.5::DOUBLE * ((nn - 10) * (ln(2 * pi() * m[11][11] / (nn - 10)) + 1) + det + ld) AS reml
 FROM sw JOIN (SELECT ratio, sum(ln(1 + ratio * n)) AS det, sum(n) AS nn, count(*) AS nb FROM bl, gr GROUP BY ratio) USING (ratio)),
best AS (SELECT * FROM fit ORDER BY reml DESC, ratio LIMIT 1),
cf AS (SELECT c AS code, i, [CASE WHEN j = 1 OR j = i THEN 1 ELSE 0 END FOR j IN range(1, 11)] AS x
 FROM (SELECT unnest({CODES!r}) AS c, unnest(range(1, 11)) AS i))"""


def block_model(t):
    """Plot volume by treatment with a random block, at the best of a list of variance ratios."""
    rows, names = gram.dummies(frame(t).filter(F.col("code").isin(CODES)), {"code": CODES})
    rows = rows.persist()
    return rows, names, mixed.random_intercept(rows, "vol_ha", names, ["block"], RATIOS)


@query("block_profile", "MD10 TC3", "stems site", f"""
WITH RECURSIVE {_BLOCKS} SELECT round(ratio, 8) AS ratio, round(reml, 4) AS reml, round(s2, 4) AS var_error FROM fit""")
def _(t):
    rows, names = gram.dummies(frame(t).filter(F.col("code").isin(CODES)), {"code": CODES})
    found = mixed.likelihood_profile(rows, "vol_ha", names, [["block"]], [[r] for r in RATIOS])
    return found.select(F.round("ratio_0", 8).alias("ratio"), F.round("reml", 4).alias("reml"), F.round("var_error", 4).alias("var_error"))


@query("block_means", "TC3 MD10", "stems site", f"""
WITH RECURSIVE {_BLOCKS}, e AS (SELECT code, x, list_transform(range(1, 11), lambda r: m[r][11]) AS b, m, s2, nn - nb - 9 AS df FROM cf, best)
SELECT code, round(list_dot_product(x::DOUBLE[], b), 5) AS emmean, df::INTEGER AS df,
 round(sqrt(s2 * list_dot_product(x::DOUBLE[], list_transform(range(1, 11), lambda r: list_dot_product(m[r][1:10], x::DOUBLE[])))), 5) AS se FROM e""")
def _(t):
    rows, _, fit = block_model(t)
    rows.unpersist()
    out = mixed.estimated_means(t.spark, fit, "code", CODES).withColumnRenamed("level", "code")
    return rounded(out, ["code", "df"], ["emmean", "se"], 5)


@query("block_pairs", "TC4 MD10", "stems site", f"""
WITH RECURSIVE {_BLOCKS}, e AS (SELECT a.code AS level_a, b.code AS level_b, list_transform(range(1, 11), lambda r: (a.x[r] - b.x[r])::DOUBLE) AS x,
  list_transform(range(1, 11), lambda r: m[r][11]) AS b, m, s2, nn - nb - 9 AS df FROM cf a JOIN cf b ON a.i < b.i, best),
p AS (SELECT level_a, level_b, list_dot_product(x, b) AS difference, df,
 sqrt(s2 * list_dot_product(x, list_transform(range(1, 11), lambda r: list_dot_product(m[r][1:10], x)))) AS se FROM e)
SELECT level_a, level_b, round(difference, 5) AS difference, round(se, 5) AS se, df::INTEGER AS df, round(difference / se, 5) AS t,
 round(abs(difference / se) * sqrt(2), 5) AS q FROM p""")
def _(t):
    rows, _, fit = block_model(t)
    rows.unpersist()
    out = mixed.estimated_pairs(t.spark, fit, "code", CODES, p_value=False)
    return rounded(out, ["level_a", "level_b", "df"], ["difference", "se", "t", "q"], 5)


@query("block_pairs_adjusted", "TC4 TC5 MD10")
def _(t):
    rows, _, fit = block_model(t)
    rows.unpersist()
    out = mixed.estimated_pairs(t.spark, fit, "code", CODES)
    return rounded(out, ["level_a", "level_b"], ["difference", "se", "p_tukey", "p_bonferroni"], 5)


@query("block_prediction", "MD10 MD3", "stems site", f"""
WITH RECURSIVE {_BLOCKS}, u AS (SELECT bl.block, ratio / (1 + ratio * bl.n) * (s[11] - list_sum(list_transform(range(1, 11), lambda r: s[r] * m[r][11]))) AS effect FROM bl, best)
SELECT uid, frame.code, round(m[1][11] + CASE WHEN cf.i > 1 THEN m[cf.i][11] ELSE 0 END, 5) AS fixed_part,
 round(m[1][11] + CASE WHEN cf.i > 1 THEN m[cf.i][11] ELSE 0 END + effect, 5) AS conditional
FROM frame JOIN u USING (block) JOIN cf USING (code), best""")
def _(t):
    rows, _, fit = block_model(t)
    scored = mixed.predict_nested(mixed.predict_nested(rows, fit, "fixed_part", 0), fit, "conditional")
    return rounded(scored, ["uid", "code"], ["fixed_part", "conditional"], 5)


@query("block_fit_bias", "MD10 MD4", "stems site", f"""
WITH RECURSIVE {_BLOCKS}, u AS (SELECT bl.block, ratio / (1 + ratio * bl.n) * (s[11] - list_sum(list_transform(range(1, 11), lambda r: s[r] * m[r][11]))) AS effect FROM bl, best),
e AS (SELECT frame.code, vol_ha - (m[1][11] + CASE WHEN cf.i > 1 THEN m[cf.i][11] ELSE 0 END + effect) AS e FROM frame JOIN u USING (block) JOIN cf USING (code), best)
SELECT code, count(*) AS n, round(avg(e), 5) AS mb, round(avg(abs(e)), 5) AS mab FROM e GROUP BY code""")
def _(t):
    rows, _, fit = block_model(t)
    scored = gram.fit_stats(mixed.predict_nested(rows, fit, "conditional"), "vol_ha", "conditional", 10, ["code"])
    return rounded(scored, ["code", "n"], ["mb", "mab"], 5)


@query("marginal_grid", "MD18 JN6")
def _(t):
    rows, fit = mixture_model(t)
    terms = ["rd", "NS_rd", "dep"]
    at = rows.agg(
        F.array(*[F.min("rd") + (F.max("rd") - F.min("rd")) * (i / 9.0) for i in range(10)]).alias("rd"),
        *[F.array(F.avg(c) - F.stddev_samp(c), F.avg(c), F.avg(c) + F.stddev_samp(c)).alias(c) for c in terms[1:]])
    rows.unpersist()
    grid = at
    for c in terms:
        grid = grid.withColumn(c, F.explode(c))
    x = [F.lit(1.0), *[F.col(c) for c in terms]]
    value = sum((float(b) * v for b, v in zip(fit.beta, x)), F.lit(0.0))
    var = sum((float(fit.cov[i, j]) * x[i] * x[j] for i in range(4) for j in range(4)), F.lit(0.0))
    out = grid.withColumns({"predicted": value, "se": F.sqrt(var)}).withColumns({
        "conf_low": F.col("predicted") - 1.959964 * F.col("se"),
        "conf_high": F.col("predicted") + 1.959964 * F.col("se")})
    return rounded(out, [], [*terms, "predicted", "se", "conf_low", "conf_high"], 5)


LEVELS = [["spp"], ["spp", "block"], ["spp", "block", "plot"]]
POINTS = [[a, b, c] for a in (0.0, 0.001, 0.01) for b in (0.0, 0.001, 0.01) for c in (0.0, 0.003, 0.01, 0.03)]


def log_heights(t):
    return t.live.withColumns({"y": F.log("ht"), "x": F.log(F.col("dbh") + 1)})


def _up(name, source, level, ratio, keys):
    """SQL of one level: its groups' intercepts integrated out, sums for the level above."""
    cells = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    side = {"n": ("n", "n"), "sx": ("n", "sx"), "sy": ("n", "sy"), "sxx": ("sx", "sx"), "sxy": ("sx", "sy"), "syy": ("sy", "sy")}
    sums = ", ".join(f"sum({c} - {ratio} / (1 + {ratio} * n) * {side[c][0]} * {side[c][1]}) AS {c}" for c in cells)
    return f"{name} AS (SELECT {keys}point, r0, r1, r2, sum(cnt) AS cnt, sum(det + ln(1 + {ratio} * n)) AS det, {sums} FROM {source} GROUP BY ALL)"


_NESTED = f"""ro AS (SELECT spp, block, plot, ln(ht) AS y, ln(dbh + 1) AS x FROM live WHERE ht IS NOT NULL),
ce AS (SELECT (SELECT avg(x) FROM ro) AS mx, (SELECT avg(y) FROM ro) AS my),
gr AS (SELECT unnest(range({len(POINTS)})) AS point, unnest({[p[0] for p in POINTS]!r}::DOUBLE[]) AS r0, unnest({[p[1] for p in POINTS]!r}::DOUBLE[]) AS r1,
 unnest({[p[2] for p in POINTS]!r}::DOUBLE[]) AS r2),
li AS (SELECT spp, block, plot, count(*) AS cnt, 0.0::DOUBLE AS det, count(*)::DOUBLE AS n, sum(x - mx) AS sx, sum(y - my) AS sy, sum((x - mx) * (x - mx)) AS sxx,
 sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy FROM ro, ce GROUP BY ALL),
l3 AS (SELECT * FROM li, gr),
{_up("l2", "l3", 2, "r2", "spp, block, ")},
{_up("l1", "l2", 1, "r1", "spp, ")},
{_up("l0", "l1", 0, "r0", "")},
so AS (SELECT *, n * sxx - sx * sx AS dd, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM l0),
sr AS (SELECT *, (sy - b * sx) / n AS a, syy - (sy - b * sx) / n * sy - b * sxy AS rss FROM so),
fit AS (SELECT *, rss / (cnt - 2) AS s2, -0.5::DOUBLE * ((cnt - 2) * (ln(2 * pi() * rss / (cnt - 2)) + 1) + det + ln(dd)) AS reml FROM sr),
best AS (SELECT * FROM fit ORDER BY reml DESC, point LIMIT 1),
u0 AS (SELECT l1.spp, l1.cnt AS n, best.r0 / (1 + best.r0 * l1.n) * (l1.sy - best.a * l1.n - best.b * l1.sx) AS u FROM l1 JOIN best USING (point)),
u1 AS (SELECT l2.spp, l2.block, l2.cnt AS n, best.r1 / (1 + best.r1 * l2.n) * (l2.sy - best.a * l2.n - best.b * l2.sx - l2.n * u0.u) AS u, u0.u AS above
 FROM l2 JOIN best USING (point) JOIN u0 USING (spp)),
u2 AS (SELECT l3.spp, l3.block, l3.plot, l3.cnt AS n, best.r2 / (1 + best.r2 * l3.n) * (l3.sy - best.a * l3.n - best.b * l3.sx - l3.n * (u1.u + u1.above)) AS u,
 u1.u + u1.above AS above FROM l3 JOIN best USING (point) JOIN u1 USING (spp, block))"""


@query("nested_height_profile", "MD11", "live", f"""
WITH {_NESTED} SELECT r0, r1, r2, round(reml, 3) AS reml, round(s2, 8) AS var_error FROM fit""")
def _(t):
    found = mixed.likelihood_profile(log_heights(t), "y", ["x"], LEVELS, POINTS)
    return found.select(*[F.col(f"ratio_{i}").alias(f"r{i}") for i in range(3)], F.round("reml", 3).alias("reml"),
                        F.round("var_error", 8).alias("var_error"))


@query("nested_height_effects", "MD11 CLN9", "live", f"""
WITH {_NESTED} SELECT 0 AS level, spp AS key, n::BIGINT AS n, round(u, 6) AS effect FROM u0
UNION ALL SELECT 1, concat_ws('/', spp, block), n::BIGINT, round(u, 6) FROM u1
UNION ALL SELECT 2, concat_ws('/', spp, block, plot), n::BIGINT, round(u, 6) FROM u2""")
def _(t):
    _, tables = mixed.nested_effects(log_heights(t), "y", "x", LEVELS, POINTS)
    out = None
    for i, (keys, table) in enumerate(zip(LEVELS, tables)):
        part = table.select(F.lit(i).alias("level"), F.concat_ws("/", *keys).alias("key"), "n",
                            F.round(f"b_{i}", 6).alias("effect"))
        out = part if out is None else out.unionByName(part)
    return out


@query("nested_height_prediction", "MD11 MD13 JN5 CLN15", "live", f"""
WITH {_NESTED}, s AS (SELECT live.*, coalesce(u2.u + u2.above, u1.u + u1.above, u0.u, 0) AS effect FROM live LEFT JOIN u0 USING (spp)
 LEFT JOIN u1 USING (spp, block) LEFT JOIN u2 USING (spp, block, plot))
SELECT uid, tree, CASE WHEN ht IS NULL THEN 1 ELSE 0 END AS imputed,
 round(coalesce(ht, exp(a + my - b * mx + effect + b * ln(dbh + 1) + s2 / 2)), 5) AS height FROM s, best, ce""")
def _(t):
    rows = log_heights(t)
    fixed, tables = mixed.nested_effects(rows, "y", "x", LEVELS, POINTS)
    from standlab.operators.joins import add_effects
    scored = add_effects(rows, [(tb, keys, f"b_{i}") for i, (tb, keys) in enumerate(zip(tables, LEVELS))])
    mu = fixed["intercept"] + F.col("effect") + fixed["slope"] * F.col("x")
    scored = clean.impute(scored, "ht", F.exp(mu + fixed["sigma2"] / 2), "height", "imputed")
    return rounded(scored, ["uid", "tree", "imputed"], ["height"], 5)


@query("nested_height_reml", "MD11 MD12")
def _(t):
    fit = mixed.nested_intercepts(log_heights(t).filter("dbh > 0"), "y", ["x"], LEVELS, weight_on="dbh")
    table = [(term, float(v)) for term, v in zip(fit.terms, fit.beta)]
    table += [(f"var({'.'.join(keys)})", v) for keys, v in zip(LEVELS, fit.variances)]
    table += [("var(residual)", fit.var_error), ("theta", fit.theta)]
    return literal_table(t.spark, [(term, round(v, 4)) for term, v in table], "term string, estimate double")


# -- counts ---------------------------------------------------------------------------------

def deduction_rows(t):
    form = clean.dedupe_by(t.stemform, ["block", "plot", "tree"], ["copy"])
    form = damage.total_deduction(form, ["deduct1", "deduct2", "deduct3"])
    plots = stand.stand_density(t.live, ["uid"]).select("uid", "sdi")
    rows = t.live.join(form.select("block", "plot", "tree", "deduct_class"), ["block", "plot", "tree"])
    rows = rows.join(plots, "uid").join(t.site.select("uid", "slope"), "uid")
    return gram.dummies(rows, {"spp": K.SPECIES})


@query("deduction_model", "MD15")
def _(t):
    rows, spp = deduction_rows(t)
    fit = counts.zinb(rows, "deduct_class", ["sdi", "slope", "dbh"], ["sdi", "dbh", *spp])
    table = [(part, term, round(v, 4)) for part in ("count", "zero") for term, v in fit[part].items()]
    table += [("theta", "theta", round(fit["theta"], 3)), ("loglik", "loglik", round(fit["loglik"], 2))]
    return literal_table(t.spark, table, "part string, term string, estimate double")


@query("deduction_response", "MD15 MD3 MD4")
def _(t):
    rows, spp = deduction_rows(t)
    rows = rows.persist()
    fit = counts.zinb(rows, "deduct_class", ["sdi", "slope", "dbh"], ["sdi", "dbh", *spp])
    scored = rows.withColumn("fit_deduction", counts.zinb_response(fit))
    out = gram.fit_stats(scored, "deduct_class", "fit_deduction", 1, ["spp"])
    return rounded(out, ["spp", "n"], ["mb", "mab"], 4)
