"""Raster cells, plot centres and species occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from standlab import constants as K
from standlab.operators import spatial, suitability, terrain
from standlab.plans.registry import query
from standlab.plans.stand import rounded

RES = 30.0

_RING = """g AS (SELECT c.row, c.col, c.z, nw.z AS nw, n.z AS n, ne.z AS ne, w.z AS w, e.z AS e, sw.z AS sw, s.z AS s, se.z AS se FROM cells c
LEFT JOIN cells nw ON nw.row = c.row - 1 AND nw.col = c.col - 1 LEFT JOIN cells n ON n.row = c.row - 1 AND n.col = c.col
LEFT JOIN cells ne ON ne.row = c.row - 1 AND ne.col = c.col + 1 LEFT JOIN cells w ON w.row = c.row AND w.col = c.col - 1
LEFT JOIN cells e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN cells sw ON sw.row = c.row + 1 AND sw.col = c.col - 1
LEFT JOIN cells s ON s.row = c.row + 1 AND s.col = c.col LEFT JOIN cells se ON se.row = c.row + 1 AND se.col = c.col + 1),
d AS (SELECT *, (ne + 2 * e + se - nw - 2 * w - sw) / 240 AS dx, (sw + 2 * s + se - nw - 2 * n - ne) / 240 AS dy,
 nw + n + ne + w + e + sw + s + se IS NOT NULL AS inside FROM g)"""


@query("crop_cells", "GE1", "cells", """
SELECT row, col, z FROM cells WHERE (col + 0.5) * 30 BETWEEN 100 AND 900 AND 1500 - (row + 0.5) * 30 BETWEEN 200 AND 1300""")
def _(t):
    return terrain.crop(t.cells, 0.0, 1500.0, RES, (100.0, 200.0, 900.0, 1300.0))


@query("slope_and_aspect", "GE2", "cells", f"""
WITH {_RING} SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope,
 round(CASE WHEN dx = 0 AND dy = 0 THEN 90 WHEN degrees(atan2(-dx, dy)) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) END, 6) AS aspect FROM d""")
def _(t):
    around = terrain.neighbours(t.cells)
    return around.select("row", "col", F.round(terrain.slope(RES), 6).alias("slope"),
                         F.round(terrain.aspect(RES), 6).alias("aspect"))


@query("position_and_ruggedness", "GE3", "cells", f"""
WITH {_RING} SELECT row, col, round(z - (nw + n + ne + w + e + sw + s + se) / 8, 6) AS tpi,
 round((abs(nw - z) + abs(n - z) + abs(ne - z) + abs(w - z) + abs(e - z) + abs(sw - z) + abs(s - z) + abs(se - z)) / 8, 6) AS tri,
 round(CASE WHEN inside THEN greatest(nw, n, ne, w, z, e, sw, s, se) - least(nw, n, ne, w, z, e, sw, s, se) END, 6) AS roughness FROM d""")
def _(t):
    around = terrain.neighbours(t.cells)
    return around.select("row", "col", F.round(terrain.position_index(), 6).alias("tpi"),
                         F.round(terrain.ruggedness(), 6).alias("tri"),
                         F.round(terrain.roughness(), 6).alias("roughness"))


@query("flow_direction", "GE4", "cells", f"""
WITH {_RING}, f AS (SELECT row, col, inside, unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS code, unnest([z - e, (z - se) / sqrt(2), z - s, (z - sw) / sqrt(2),
 z - w, (z - nw) / sqrt(2), z - n, (z - ne) / sqrt(2)]) AS fall FROM d)
SELECT row, col, CASE WHEN inside THEN code END AS flowdir FROM f
QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY fall DESC NULLS LAST, code) = 1""")
def _(t):
    return terrain.neighbours(t.cells).select("row", "col", terrain.flow_direction().alias("flowdir"))


@query("wetness_index", "GE5")
def _(t):
    return rounded(terrain.wetness(t.cells, RES), ["row", "col"], ["filled", "upslope_area", "twi"])


@query("stack_layers", "GE6", "cells", """
SELECT a.row, a.col, a.z, b.z2 FROM cells a JOIN (SELECT row, col, z * z AS z2 FROM cells WHERE col > 3) b USING (row, col)""")
def _(t):
    other = t.cells.filter("col > 3").select("row", "col", (F.col("z") * F.col("z")).alias("z2"))
    return terrain.stack(t.cells, other)


@query("covariates_at_plots", "GE7", "points cells", """
SELECT p.id, CAST(floor((1500 - p.y) / 30) AS INTEGER) AS row, CAST(floor(p.x / 30) AS INTEGER) AS col, c.z FROM points p
LEFT JOIN cells c ON c.row = CAST(floor((1500 - p.y) / 30) AS INTEGER) AND c.col = CAST(floor(p.x / 30) AS INTEGER)""")
def _(t):
    return spatial.covariates_at(t.points, t.cells, 0.0, 1500.0, RES).select("id", "row", "col", "z")


_E2 = "(2 / 298.257222101::DOUBLE - 1 / (298.257222101::DOUBLE * 298.257222101::DOUBLE))"


@query("project_points", "GE8", "points", f"""
WITH k AS (SELECT id, lon, radians(lat) AS phi, {_E2} AS e2, {_E2} / (1 - {_E2}) AS ep2, radians(lon + 69) * cos(radians(lat)) AS a FROM points),
u AS (SELECT *, tan(phi) * tan(phi) AS tt, ep2 * cos(phi) * cos(phi) AS cc, 6378137 / sqrt(1 - e2 * sin(phi) * sin(phi)) AS nu,
 6378137 * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi)
  + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - (35 * e2 ** 3 / 3072) * sin(6 * phi)) AS arc FROM k)
SELECT id, round(radians(lon) * 6378137, 4) AS web_x, round(ln(tan(pi() / 4 + phi / 2)) * 6378137, 4) AS web_y,
 round(500000 + 0.9996::DOUBLE * nu * (a + (1 - tt + cc) * a ** 3 / 6 + (5 - 18 * tt + tt * tt + 72 * cc - 58 * ep2) * a ** 5 / 120), 4) AS tm_x,
 round(0.9996::DOUBLE * (arc + nu * tan(phi) * (a ** 2 / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * a ** 4 / 24 + (61 - 58 * tt + tt * tt + 600 * cc - 330 * ep2) * a ** 6 / 720)), 4) AS tm_y
FROM u""")
def _(t):
    wx, wy = spatial.web_mercator(F.col("lon"), F.col("lat"))
    tx, ty = spatial.transverse_mercator(F.col("lon"), F.col("lat"))
    return t.points.select("id", F.round(wx, 4).alias("web_x"), F.round(wy, 4).alias("web_y"),
                           F.round(tx, 4).alias("tm_x"), F.round(ty, 4).alias("tm_y"))


@query("semivariogram", "GE9", "points", """
WITH c AS (SELECT id, floor(x / 60) AS cx, floor(y / 60) AS cy, resid FROM points),
p AS (SELECT sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) * 60 AS d, a.resid - b.resid AS v FROM c a JOIN c b ON a.id < b.id)
SELECT CAST(floor(d / 120) AS INTEGER) AS lag_class, count(*) AS pairs, round(avg(v * v) / 2, 4) AS gamma FROM p WHERE d <= 480 GROUP BY 1""")
def _(t):
    rows = spatial.semivariogram(t.points, "resid", 60.0, 480.0, 120.0)
    return rows.withColumn("gamma", F.round("gamma", 4))


def _logit(odds):
    terms = " + ".join(f"{k} * ln({v}::DOUBLE)" for k, v in odds.items() if k != "intercept" and v is not None)
    return f"1 / (1 + exp(-(ln({odds['intercept']}::DOUBLE) + {terms})))"


_SCORED = ("scored AS (SELECT uid, " + ", ".join(
    f"{_logit(o)} AS p_{s.lower()}" for s, o in K.SUITABILITY_ODDS.items())
    + " FROM (SELECT uid, vpdmax, tmax, ppt, swi AS twi, rad AS wsi FROM site))")


def scored(t):
    site = t.site.select("uid", "vpdmax", "tmax", "ppt", F.col("swi").alias("twi"), F.col("rad").alias("wsi"))
    return suitability.suitability(site)


@query("species_suitability", "MD19", "site", f"""
WITH {_SCORED} SELECT uid, round(p_bs, 10) AS p_bs, round(p_rs, 10) AS p_rs, round(p_ws, 10) AS p_ws,
 round(p_bs / max(p_bs) OVER (), 8) AS bs_suitability, round(p_rs / max(p_rs) OVER (), 8) AS rs_suitability,
 round(p_ws / max(p_ws) OVER (), 8) AS ws_suitability FROM scored""")
def _(t):
    names = [s.lower() for s in K.SUITABILITY_ODDS]
    return scored(t).select("uid", *[F.round(f"p_{s}", 10).alias(f"p_{s}") for s in names],
                            *[F.round(f"{s}_suitability", 8).alias(f"{s}_suitability") for s in names])


def presence(t):
    """Trees of the plot's site score, labelled by whether the stem is a red spruce."""
    rows = t.live.select("uid", (F.col("spp") == "RS").cast("int").alias("present"))
    return rows.join(scored(t).select("uid", F.round("p_rs", 8).alias("score")), "uid")


@query("occurrence_auc", "MD20", "live site", f"""
WITH {_SCORED}, r AS (SELECT CASE WHEN spp = 'RS' THEN 1 ELSE 0 END AS y, round(p_rs, 8) AS s FROM live JOIN scored USING (uid)),
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM r)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS auc,
 count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM k""")
def _(t):
    return suitability.auc(presence(t), "present", "score").withColumn("auc", F.round("auc", 8))


@query("occurrence_fit", "MD19")
def _(t):
    rows = t.live.select("uid", (F.col("spp") == "RS").cast("int").alias("present"), "dbh").join(
        t.site.select("uid", "dep", "tmax", "swi"), "uid")
    return rounded(suitability.fit_occurrence(rows, "present", ["dep", "tmax", "swi", "dbh"]), ["term"],
                   ["estimate", "odds_ratio"], 5)


@query("forest_importance", "MD17")
def _(t):
    rows = t.live.select("uid", "dbh", "hcb", "disc", "lai").join(
        t.site.select("uid", "dep", "elevation", "slope"), "uid")
    return suitability.forest_importance(rows, "hcb", ["dbh", "disc", "lai", "dep", "elevation", "slope"])
