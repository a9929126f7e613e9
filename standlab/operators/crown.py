"""Vertical crown profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from standlab import constants as K
from standlab.functions import columns as C

STEPS = 100


def crown_profile(trees: DataFrame, plot: list[str], group: list[str], top: str, base: str,
                  factor: float = K.TREES_PER_ACRE, steps: int = STEPS) -> DataFrame:
    """Crowns per acre spanning each of ``steps`` relative heights of a plot.

    Height runs from the plot's lowest crown base (0) to its highest tip (1).  One line per
    group counts the crowns over each level, beside the join to the plot's frame and without
    another shuffle; only these lines are unfolded into levels.  The frame, one row per plot,
    is hashed, so that trees are not sorted.
    """
    last = float(steps - 1)
    frame = trees.groupBy(*plot).agg(C.strict_max(top).alias("_top"), C.strict_min(base).alias("_low"))
    span = F.col("_top") - F.col("_low")
    placed = trees.select(*plot, *group, top, base).join(frame.hint("shuffle_hash"), plot, "left").select(
        *plot, *group,
        F.ceil(C.ratio(F.col(base) - F.col("_low"), span) * last).alias("_from"),
        F.floor(C.ratio(F.col(top) - F.col("_low"), span) * last).alias("_to"))
    keys = [*plot, *group]
    over = {f"_n{i}": (F.col("_from") <= i) & (F.col("_to") >= i) for i in range(steps)}
    counts = placed.groupBy(*keys).agg(*[F.count_if(inside).alias(c) for c, inside in over.items()])
    return (counts.select(*keys, F.posexplode(F.array(*over)).alias("step", "_n"))
            .select(*keys, "step", (F.col("step") / last).alias("prop"), (F.col("_n") * F.lit(factor)).alias("cr_points")))


def average_profile(profile: DataFrame, by: list[str]) -> DataFrame:
    """Replicate mean of the profile over levels that hold a crown."""
    return (profile.filter("cr_points > 0").groupBy(*by, "step", "prop")
            .agg(F.avg("cr_points").alias("cr_points")))
