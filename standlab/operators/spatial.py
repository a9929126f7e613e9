"""Plot centres: projections, covariates from cells, semivariogram."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: ellipsoids and the stored projections
WEB_MERCATOR_RADIUS = 6378137.0
GRS80_AXIS = 6378137.0
GRS80_INVERSE_FLATTENING = 298.257222101
CENTRAL_MERIDIAN = -69.0
SCALE_FACTOR = 0.9996
FALSE_EASTING = 500000.0


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north on the sphere."""
    x = F.radians(lon) * WEB_MERCATOR_RADIUS
    y = F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * WEB_MERCATOR_RADIUS
    return x, y


def transverse_mercator(lon: Column, lat: Column, lon0: float = CENTRAL_MERIDIAN) -> tuple[Column, Column]:
    """Metres east and north on GRS 80, by the usual series in the distance from ``lon0``."""
    flat = 1 / GRS80_INVERSE_FLATTENING
    e2 = flat * (2 - flat)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    nu = GRS80_AXIS / F.sqrt(1 - e2 * s * s)
    t2, c2 = t * t, ep2 * c * c
    a = F.radians(lon - lon0) * c
    arc = GRS80_AXIS * (
        (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * F.sin(2 * phi)
        + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * F.sin(4 * phi)
        - (35 * e2 ** 3 / 3072) * F.sin(6 * phi))
    a2 = a * a
    east = a + a * a2 * (1 - t2 + c2) / 6 + a * a2 * a2 * (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * ep2) / 120
    north = arc + nu * t * (a2 / 2 + a2 * a2 * (5 - t2 + 9 * c2 + 4 * c2 * c2) / 24
                            + a2 * a2 * a2 * (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * ep2) / 720)
    return FALSE_EASTING + SCALE_FACTOR * nu * east, SCALE_FACTOR * north


def cell_index(x: Column, origin: float, res: float) -> Column:
    return F.floor((x - origin) / res).cast("int")


def covariates_at(points: DataFrame, cells: DataFrame, x0: float, y0: float, res: float,
                  how: str = "left") -> DataFrame:
    """Cell values under each point; as in ``terrain.crop``, ``y0`` is the top edge and rows run down."""
    at = points.withColumns({"row": F.floor((y0 - F.col("y")) / res).cast("int"), "col": cell_index(F.col("x"), x0, res)})
    return at.join(cells, ["row", "col"], how)


def semivariogram(points: DataFrame, value: str, res: float, max_lag: float, width: float) -> DataFrame:
    """Half mean squared difference by distance class, distances between cell centres.

    Points collapse to count, sum and square sum per cell; a pair of cells then gives the
    sum over all its point pairs in closed form.  Each cell meets a fixed number of
    cells around it, and no pair of points is ever formed.
    """
    centre = points.agg(F.avg(value)).scalar()
    v = F.col(value) - centre
    cells = points.filter(F.col(value).isNotNull()).groupBy(
        cell_index(F.col("x"), 0.0, res).alias("cx"), cell_index(F.col("y"), 0.0, res).alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    reach = int(max_lag // res)
    steps = [(dx, dy) for dy in range(0, reach + 1) for dx in range(-reach, reach + 1)
             if (dy > 0 or dx > 0) and math.hypot(dx, dy) * res <= max_lag]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"),
                                 F.lit(math.hypot(dx, dy) * res).alias("d")) for dx, dy in steps])
    c = F.col
    other = cells.select(c("cx"), c("cy"), c("n").alias("n2"), c("s").alias("s2"), c("q").alias("q2"))
    near = (cells.withColumn("_o", F.explode(offsets))
            .select((c("cx") + c("_o.dx")).alias("cx"), (c("cy") + c("_o.dy")).alias("cy"),
                    c("_o.d").alias("d"), "n", "s", "q")
            .join(other, ["cx", "cy"])
            .select("d", (c("n") * c("n2")).alias("pairs"),
                    (c("n2") * c("q") + c("n") * c("q2") - 2 * c("s") * c("s2")).alias("sq")))
    same = cells.filter("n > 1").select(F.lit(0.0).alias("d"), (c("n") * (c("n") - 1) / 2).cast("bigint").alias("pairs"),
                                        (c("n") * c("q") - c("s") * c("s")).alias("sq"))
    return (near.unionByName(same).groupBy(F.floor(c("d") / width).cast("int").alias("lag_class"))
            .agg(F.sum("pairs").alias("pairs"), (F.sum("sq") / F.sum("pairs") / 2).alias("gamma")))
