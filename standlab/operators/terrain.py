"""Terrain from elevation cells (row, col, z), rows counted southwards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from standlab.session import cut_lineage

RING = ["nw", "n", "ne", "w", "e", "sw", "s", "se"]

# fixed values: direction codes of the eight neighbours and their grid steps (row, col)
FLOW = {"e": (1, 0, 1), "se": (2, 1, 1), "s": (4, 1, 0), "sw": (8, 1, -1),
        "w": (16, 0, -1), "nw": (32, -1, -1), "n": (64, -1, 0), "ne": (128, -1, 1)}


def _haloed(cells: DataFrame, tile: int) -> DataFrame:
    """Each cell in its own tile and in the tiles it borders on."""
    def tiles(c):
        return F.array_distinct(F.array(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile)))
    return cells.withColumn("_tr", F.explode(tiles("row"))).withColumn("_tc", F.explode(tiles("col")))


def _own() -> callable:
    return lambda t: (F.floor(F.col("row") / t) == F.col("_tr")) & (F.floor(F.col("col") / t) == F.col("_tc"))


def neighbours(cells: DataFrame, tile: int = 256) -> DataFrame:
    """The eight neighbours beside each cell, null past an edge or gap.

    Only tile borders are copied.  One shuffle by tile serves both sorts: left and right
    along a row, then above and below along a column.
    """
    haloed = _haloed(cells.select("row", "col", "z"), tile).repartition("_tr", "_tc")
    along = W.partitionBy("_tr", "_tc", "row").orderBy("col")
    down = W.partitionBy("_tr", "_tc", "col").orderBy("row")

    def side(value, key, step, window):
        move = F.lag if step < 0 else F.lead
        return F.when(move(key).over(window) == F.col(key) + step, move(value).over(window))

    lines = haloed.withColumns({"w": side("z", "col", -1, along), "e": side("z", "col", 1, along)})
    lines = lines.withColumn("_line", F.struct("w", "z", "e"))
    both = lines.withColumns({"_up": side("_line", "row", -1, down), "_dn": side("_line", "row", 1, down)})
    return both.filter(_own()(tile)).select(
        "row", "col", "z", F.col("_up.w").alias("nw"), F.col("_up.z").alias("n"), F.col("_up.e").alias("ne"),
        "w", "e", F.col("_dn.w").alias("sw"), F.col("_dn.z").alias("s"), F.col("_dn.e").alias("se"))


def _inside(value: Column) -> Column:
    whole = F.lit(True)
    for c in RING:
        whole = whole & F.col(c).isNotNull()
    return F.when(whole, value)


def _gradient(res: float) -> tuple[Column, Column]:
    c = F.col
    dx = (c("ne") + 2 * c("e") + c("se") - c("nw") - 2 * c("w") - c("sw")) / (8 * res)
    dy = (c("sw") + 2 * c("s") + c("se") - c("nw") - 2 * c("n") - c("ne")) / (8 * res)
    return dx, dy


def slope(res: float) -> Column:
    dx, dy = _gradient(res)
    return _inside(F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))))


def aspect(res: float) -> Column:
    """Downslope direction clockwise from north; flat cells face 90 degrees."""
    dx, dy = _gradient(res)
    angle = F.degrees(F.atan2(-dx, dy))
    return _inside(F.when((dx == 0) & (dy == 0), 90.0).when(angle < 0, angle + 360).otherwise(angle))


def position_index() -> Column:
    return _inside(F.col("z") - sum((F.col(c) for c in RING), F.lit(0.0)) / 8)


def ruggedness() -> Column:
    return _inside(sum((F.abs(F.col(c) - F.col("z")) for c in RING), F.lit(0.0)) / 8)


def roughness() -> Column:
    cells = [F.col(c) for c in [*RING, "z"]]
    return _inside(F.greatest(*cells) - F.least(*cells))


def flow_direction() -> Column:
    """Code of the steepest drop (or smallest rise); ties go to the lowest code."""
    def drop(c):
        _, dr, dc = FLOW[c]
        fall = F.col("z") - F.col(c)
        return fall / float(np.sqrt(2.0)) if dr and dc else fall

    best = F.greatest(*[drop(c) for c in FLOW])
    code = F.lit(None).cast("int")
    for c, (value, _, _) in reversed(FLOW.items()):
        code = F.when(drop(c) == best, value).otherwise(code)
    return _inside(code)


def derivatives(cells: DataFrame, res: float, tile: int = 256) -> DataFrame:
    """All six terrain layers from one neighbourhood pass."""
    return neighbours(cells, tile).select(
        "row", "col", "z", slope(res).alias("slope"), aspect(res).alias("aspect"),
        position_index().alias("tpi"), ruggedness().alias("tri"), roughness().alias("roughness"),
        flow_direction().alias("flowdir"))


def crop(cells: DataFrame, x0: float, y0: float, res: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Cells whose centre lies in (xmin, ymin, xmax, ymax)."""
    x = x0 + (F.col("col") + 0.5) * res
    y = y0 - (F.col("row") + 0.5) * res
    return cells.filter(x.between(box[0], box[2]) & y.between(box[1], box[3]))


def stack(*layers: DataFrame) -> DataFrame:
    out = layers[0]
    for layer in layers[1:]:
        out = out.join(layer, ["row", "col"])
    return out


def fill_depressions(cells: DataFrame, tile: int = 256, rise: float = 1e-4, max_passes: int = 200) -> DataFrame:
    """Lowest surface over ``z`` on which every cell drains to the edge.

    Water level is relaxed inside each tile until it stands still, then border cells are
    exchanged; passes grow with the number of tiles along a path, not with its cells.
    ``rise`` per step keeps filled areas draining.  Tiles hold a fixed number of cells.
    """
    edge = F.lit(False)
    for c in RING:
        edge = edge | F.col(c).isNull()
    start = neighbours(cells, tile).select(
        "row", "col", "z", F.when(edge, F.col("z")).otherwise(F.lit(float("inf"))).alias("filled"))
    state = cut_lineage(start)

    def relax(pdf):
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile - 1, int(pdf["_tc"].iloc[0]) * tile - 1
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        shape = (tile + 2, tile + 2)
        z, level = np.full(shape, np.nan), np.full(shape, np.inf)
        z[r, c], level[r, c] = pdf["z"], pdf["filled"]
        own = np.zeros(shape, bool)
        own[1:-1, 1:-1] = True
        own &= ~np.isnan(z)
        while True:
            low = np.full(shape, np.inf)
            for _, dr, dc in FLOW.values():
                moved = np.full(shape, np.inf)
                moved[max(-dr, 0):shape[0] - max(dr, 0), max(-dc, 0):shape[1] - max(dc, 0)] = \
                    level[max(dr, 0):shape[0] - max(-dr, 0), max(dc, 0):shape[1] - max(-dc, 0)]
                low = np.minimum(low, moved + rise * (1.4142135623730951 if dr and dc else 1.0))
            new = np.where(own, np.minimum(level, np.maximum(z, low)), level)
            if np.array_equal(new, level):
                break
            level = new
        keep = own[r, c]
        return pd.DataFrame({"row": pdf["row"][keep], "col": pdf["col"][keep], "z": pdf["z"][keep],
                             "filled": level[r, c][keep],
                             "moved": level[r, c][keep] != pdf["filled"][keep].to_numpy()})

    for _ in range(max_passes):
        step = _haloed(state, tile).groupBy("_tr", "_tc").applyInPandas(
            relax, "row int, col int, z double, filled double, moved boolean")
        step = cut_lineage(step)
        state = step.drop("moved")
        if step.filter("moved").isEmpty():
            return state
    raise RuntimeError("depression filling did not settle; raise max_passes or the tile size")


def upslope_cells(directions: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Cells draining through each cell, itself included, from direction codes.

    Every round doubles the distance looked ahead, so the number of rounds is the
    logarithm of the longest flow path.
    """
    key = F.col("row").cast("bigint") * F.lit(1 << 31) + F.col("col")
    target = F.lit(None).cast("bigint")
    for code, dr, dc in FLOW.values():
        target = F.when(F.col("flowdir") == code, key + dr * (1 << 31) + dc).otherwise(target)
    state = cut_lineage(directions.select("row", "col", key.alias("id"), target.alias("next"),
                                          F.lit(1).cast("bigint").alias("cells")))
    for _ in range(max_rounds):
        moving = state.filter("next IS NOT NULL")
        if moving.isEmpty():
            return state.select("row", "col", "cells")
        inflow = moving.groupBy(F.col("next").alias("id")).agg(F.sum("cells").alias("_in"))
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("_ahead"))
        state = cut_lineage(
            state.join(inflow, "id", "left").join(ahead, "next", "left")
            .select("row", "col", "id", F.col("_ahead").alias("next"),
                    (F.col("cells") + F.coalesce("_in", F.lit(0))).alias("cells")))
    raise RuntimeError("flow directions contain a loop")


def wetness(cells: DataFrame, res: float, tile: int = 256, min_slope: float = 0.1) -> DataFrame:
    """Filled elevation, upslope area and wetness index ln(a / tan b).

    Slopes below ``min_slope`` degrees count as that much, so flat cells stay finite.
    """
    filled = fill_depressions(cells, tile)
    around = neighbours(filled.select("row", "col", F.col("filled").alias("z")), tile).select(
        "row", "col", F.col("z").alias("filled"), slope(res).alias("_slope"),
        flow_direction().alias("flowdir"))
    around = cut_lineage(around)
    area = upslope_cells(around.select("row", "col", "flowdir"))
    steep = F.tan(F.radians(F.greatest("_slope", F.lit(min_slope))))
    out = around.join(area, ["row", "col"])
    return out.select("row", "col", "filled", (F.col("cells") * F.lit(res * res)).alias("upslope_area"),
                      F.when(F.col("_slope").isNotNull(), F.log(F.col("cells") * F.lit(res) / steep)).alias("twi"))
