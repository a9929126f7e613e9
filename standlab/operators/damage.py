"""Stem damage: deductions, merchantable volume, weevil incidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from standlab import constants as K
from standlab.functions import columns as C
from standlab.operators.reshape import lengthen


def total_deduction(df: DataFrame, cols: list[str], out: str = "t_deduct") -> DataFrame:
    """Mean deduction per cent of a stem, blanks counting as 0, and its 5 % class."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0)) / len(cols)
    return df.withColumn(out, total).withColumn("deduct_class", C.bin_round(out, 5.0))


def merchantable(df: DataFrame, volume_ac: str, deduction: str) -> DataFrame:
    """Volume left after the deduction class (at most all of it), in metric units."""
    share = C.clamp(C.bin_round(deduction, 5.0) / 100.0, high=1.0)
    return (df.withColumn("fit_deduct_class", share)
            .withColumn("adj_vol", F.col(volume_ac) * F.col("fit_deduct_class"))
            .withColumn("final_vol", F.col(volume_ac) - F.col("adj_vol"))
            .withColumn("merch_vol_ha", F.col("final_vol") * K.FT3_AC_TO_M3_HA))


def weevil_incidence(trees: DataFrame, by: list[str], cols: list[str],
                     codes: list[str] = K.WEEVIL_CODES, token: str | None = None) -> DataFrame:
    """Damage records with a weevil code: count, per cent of ten, per hectare.

    ``token`` matches one part of a compound code instead of the listed codes, which
    also finds ``WV/FK`` and ``BF/WV``.
    """
    long = lengthen(trees.select(*by, *cols), by, cols, "dam_num", "dam_value")
    value = F.col("dam_value")
    match = F.array_contains(F.split(value, "/"), token) if token else value.isin(codes)
    return (long.filter(match).groupBy(*by).agg(F.count(F.lit(1)).alias("n_trees"))
            .withColumn("weevil_percent", F.col("n_trees") / 10)
            .withColumn("n_trees_per_hectare",
                        F.col("n_trees") * K.TREES_PER_ACRE * K.ACRES_PER_HA))
