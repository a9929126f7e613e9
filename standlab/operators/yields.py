"""Mixture yield against pure stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from standlab import constants as K
from standlab.functions import columns as C
from standlab.operators.joins import attach_pure
from standlab.session import small_side


def block_means(plots: DataFrame, volume: str) -> DataFrame:
    return plots.groupBy("block", "code").agg(F.avg(volume).alias("mean_block_vol"))


def overyielding_weighted(plots: DataFrame, volume: str, shares: list[str]) -> DataFrame:
    """Pure-stand block means weighted by species share, over the mixture's volume.

    ``shares`` are the plot's species shares in the order of the pure treatments; a
    value below one means the mixture yields more than expected.
    """
    wide = attach_pure(plots, block_means(plots, volume), "mean_block_vol", K.PURE)
    expected = sum((F.col(s) * F.col(p) for s, p in zip(shares, K.PURE)), F.lit(0.0))
    return (wide.withColumn("oy", C.ratio(expected, volume))
            .filter(F.col("code").isin(K.MIXED)).drop(*K.PURE))


def _pure_lookup(means: DataFrame, code: str, value: str) -> DataFrame:
    return means.filter(F.col("code").isin(K.PURE)).select(
        "block", F.col("code").alias(code), F.col("mean_block_vol").alias(value))


def overyielding_simple(plots: DataFrame, volume: str) -> DataFrame:
    """Mean mixture over the mean of its two pure stands, with both deviations."""
    means = block_means(plots, volume)
    mixed = means.filter(F.col("code").isin(K.MIXED)).withColumns(
        {"p1": F.substring("code", 1, 1), "p2": F.substring("code", 2, 1)})
    rows = (mixed.join(_pure_lookup(means, "p1", "v1"), ["block", "p1"])
            .join(_pure_lookup(means, "p2", "v2"), ["block", "p2"])
            .withColumn("mono", (F.col("v1") + F.col("v2")) / 2))
    return (rows.groupBy("code").agg(
        F.avg("mean_block_vol").alias("mean_mix"), F.avg("mono").alias("mean_mono"),
        F.stddev_samp("mean_block_vol").alias("sd_mix"), F.stddev_samp("mono").alias("sd_mono"))
        .withColumn("overyielding", C.ratio("mean_mix", "mean_mono")))


def best_pure(code="code"):
    pairs = [F.lit(x) for kv in K.BEST_PURE.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col(code))


def transgressive(plots: DataFrame, volume: str) -> DataFrame:
    """Mixture plot volume over its block's mean of the better pure species."""
    rows = plots.filter(F.col("code").isin(K.MIXED)).withColumn("best", best_pure())
    pure = small_side(_pure_lookup(block_means(plots, volume), "best", "pure_vol"))
    return rows.join(pure, ["block", "best"], "left").withColumn("toy", C.ratio(volume, "pure_vol"))


def transgressive_simple(plots: DataFrame, volume: str) -> DataFrame:
    """Mean of mixture block means over mean of the better pure species' block means."""
    means = block_means(plots, volume)
    rows = means.filter(F.col("code").isin(K.MIXED)).withColumn("best", best_pure())
    rows = rows.join(_pure_lookup(means, "best", "pure_vol"), ["block", "best"])
    return (rows.groupBy("code", "best").agg(
        F.avg("mean_block_vol").alias("mean_mix"), F.avg("pure_vol").alias("mean_best"),
        F.stddev_samp("mean_block_vol").alias("sd_mix"), F.stddev_samp("pure_vol").alias("sd_best"))
        .withColumn("toy", C.ratio("mean_mix", "mean_best")))
