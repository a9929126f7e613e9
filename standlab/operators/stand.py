"""Tree, species and plot metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from standlab import constants as K
from standlab.functions import columns as C

PLOT = ["block", "plot", "uid", "code"]


def predict_height(df: DataFrame, coef: DataFrame, out: str = "ht_fit") -> DataFrame:
    """Height from diameter by species: 4.5 + exp(a + b / (d + 1)); null without coefficients."""
    curve = 4.5 + F.exp(F.col("ht_a") + F.col("ht_b") / (F.col("dbh") + 1))
    return df.join(coef, "spp", "left").withColumn(out, curve)


def crown_width(a="cw_a", b="cw_b", dbh="dbh") -> Column:
    return F.col(a) * F.pow(F.col(dbh), F.col(b))


def stem_volume(a="vol_a", b="vol_b", c="vol_c", dbh="dbh", height="final_ht") -> Column:
    """Cubic metres from the combined-variable form a * D^b * H^c (cm, m)."""
    return (F.col(a) * F.pow(C.inches_to_cm(dbh), F.col(b))
            * F.pow(C.feet_to_m_coarse(height), F.col(c)))


def tree_metrics(trees: DataFrame, coef: DataFrame) -> DataFrame:
    """Fill heights and add volume and crown width from a species coefficient table."""
    return (predict_height(trees, coef)
            .withColumn("final_ht", F.coalesce("ht", "ht_fit"))
            .withColumns({"vol": stem_volume(), "cw": crown_width()}))


def stand_density(trees: DataFrame, by: list[str], factor: float = K.TREES_PER_ACRE) -> DataFrame:
    """Basal area and stems per acre, quadratic mean diameter, densities.

    Squared diameters are summed before the constant is applied: measured diameters
    have few binary digits, so the sum is exact and independent of row order.
    """
    sums = trees.groupBy(*by).agg(F.sum(F.col("dbh") * F.col("dbh")).alias("_d2"),
                                  F.count(F.lit(1)).alias("n_trees"))
    return (sums
            .withColumn("bapa", F.col("_d2") * K.BASAL_AREA_FT2 * factor)
            .withColumn("tpa", F.col("n_trees") * F.lit(factor))
            .withColumn("qmd", F.sqrt(F.col("_d2") / F.col("n_trees")))
            .withColumn("rd", C.relative_density("bapa", "qmd"))
            .withColumn("sdi", C.stand_density_index("tpa", "qmd"))
            .drop("_d2"))


def crown_competition(trees: DataFrame, by: list[str], width: str = "cw",
                      strict: bool = True, factor: float = K.TREES_PER_ACRE) -> DataFrame:
    """Crown competition factor: crown area per acre in per cent of an acre."""
    total = C.strict_sum if strict else F.sum
    area = total(C.crown_area(width) * factor)
    return trees.groupBy(*by).agg((100.0 * area / K.SQFT_PER_ACRE).alias("ccf"))


def plot_summary(trees: DataFrame, by: list[str] = PLOT, strict: bool = False,
                 per_ha: float = K.ACRES_PER_HA, factor: float = K.TREES_PER_ACRE) -> DataFrame:
    """One pass over the trees to one row per plot; later columns use earlier ones."""
    total, mean = (C.strict_sum, C.strict_mean) if strict else (F.sum, F.avg)
    d2 = F.col("dbh") * F.col("dbh")
    return (trees.groupBy(*by)
            .agg(total(d2).alias("_d2"), F.count(F.lit(1)).alias("_n"),
                 (total(C.crown_area("cw") * factor) / K.SQFT_PER_ACRE * 100.0).alias("ccf"),
                 mean("lai").alias("lai"),
                 (total(F.col("vol") * factor) * per_ha).alias("vol_ha"))
            .withColumn("bapa", F.col("_d2") * K.BASAL_AREA_FT2 * factor)
            .withColumn("tpa", F.col("_n") * F.lit(factor))
            .withColumn("qmd", C.qmd("bapa", "tpa"))
            .withColumn("rd", C.relative_density("bapa", "qmd"))
            .withColumn("sdi", C.stand_density_index("tpa", "qmd"))
            .drop("_d2", "_n"))


def plot_and_species(trees: DataFrame, plot: list[str], spp: str = "spp",
                     factor: float = K.TREES_PER_ACRE) -> DataFrame:
    """Species rows with their plot's totals beside them, from one pass over the trees.

    Only the species rows are shuffled; plot totals are sums over those few rows.
    """
    rows = trees.groupBy(*plot, spp).agg(
        F.sum(F.col("dbh") * F.col("dbh")).alias("_d2"), F.count(F.lit(1)).alias("_n"),
        F.sum("vol").alias("_v"))
    w = W.partitionBy(*plot)
    out = rows
    for prefix, d2, n, v in [("sp_", F.col("_d2"), F.col("_n"), F.col("_v")),
                             ("", F.sum("_d2").over(w), F.sum("_n").over(w), F.sum("_v").over(w))]:
        out = out.withColumns({
            prefix + "bapa": d2 * K.BASAL_AREA_FT2 * factor,
            prefix + "tpa": n * F.lit(factor),
            prefix + "qmd": F.sqrt(d2 / n),
            prefix + "vol_ha": v * factor * K.ACRES_PER_HA})
        out = out.withColumn(prefix + "rd",
                             C.relative_density(prefix + "bapa", prefix + "qmd"))
    return out.drop("_d2", "_n", "_v")


def plot_species_totals(trees: DataFrame, plot: list[str], spp: str = "spp",
                        factor: float = K.TREES_PER_ACRE) -> DataFrame:
    """Plot rows (null species) and species rows in one long table, by grouping sets."""
    cols = [F.col(c) for c in (*plot, spp)]
    return (trees.groupingSets([cols[:-1], cols], *cols)
            .agg((F.sum(F.col("dbh") * F.col("dbh")) * K.BASAL_AREA_FT2 * factor).alias("bapa"),
                 (F.count(F.lit(1)) * F.lit(factor)).alias("tpa")))


def species_ratios(trees: DataFrame, plot: list[str]) -> DataFrame:
    """Species over plot: relative density and volume."""
    both = plot_and_species(trees, plot)
    return both.select(*plot, "spp", C.ratio("sp_rd", "rd").alias("rel_rd"),
                       C.ratio("sp_vol_ha", "vol_ha").alias("rel_vol"))


def importance_values(trees: DataFrame, plot: list[str]) -> DataFrame:
    """Mean of relative stem count and relative basal area per species."""
    rows = trees.groupBy(*plot, "spp").agg(
        F.sum(F.col("dbh") * F.col("dbh")).alias("_d2"), F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*plot)
    return (rows.withColumns({"prop_tpa": F.col("_n") / F.sum("_n").over(w),
                              "prop_ba": C.ratio("_d2", F.sum("_d2").over(w))})
            .withColumn("iv", (F.col("prop_tpa") + F.col("prop_ba")) / 2.0)
            .drop("_d2", "_n"))


def share_check(df: DataFrame, by: list[str], share: str, tolerance: float = 1e-9) -> DataFrame:
    """Plots whose shares do not sum to one."""
    total = df.groupBy(*by).agg(F.sum(share).alias("checker"))
    return total.filter(F.abs(F.col("checker") - 1.0) > tolerance)


def height_diameter_ratio(trees: DataFrame, replicate: list[str], treatment: list[str]) -> DataFrame:
    """Metric height over diameter: tree -> replicate mean -> treatment summary."""
    ratio = C.ratio(C.feet_to_m("final_ht"), C.inches_to_m("dbh"))
    means = (trees.withColumn("hdr", ratio).filter(C.is_finite("hdr"))
             .groupBy(*replicate).agg(F.avg("hdr").alias("_m")))
    return means.groupBy(*treatment).agg(
        F.avg("_m").alias("mean_hdr"), F.stddev_samp("_m").alias("sd_hdr"),
        F.min("_m").alias("min_hdr"), F.max("_m").alias("max_hdr"))


def site_index(height, age: float, base_age: float, k="si_k", m="si_m") -> Column:
    """Height at the base age on a Chapman-Richards curve through (age, height)."""
    def grown(t):
        return F.pow(1.0 - F.exp(-F.col(k) * t), F.col(m))

    h = F.col(height) if isinstance(height, str) else height
    return h * grown(float(base_age)) / grown(float(age))


def site_summary(trees: DataFrame, by: list[str], age: float, base_age: float = 50.0) -> DataFrame:
    """Mean site index per plot, and the dominant height it implies at the same age."""
    si = site_index("final_ht", age, base_age)
    return (trees.withColumn("_si", si)
            .withColumn("_top", site_index("_si", base_age, age))
            .groupBy(*by).agg(F.avg("_si").alias("mean_si"), F.avg("_top").alias("top_height")))


def diameter_distribution(trees: DataFrame, by: list[str], width_cm: float = 3.0) -> DataFrame:
    """Trees per hectare by right-closed diameter class."""
    cm = C.inches_to_cm("dbh")
    top = trees.agg(F.max(cm).alias("m")).scalar()
    classed = trees.withColumn("dbh_class", C.bin_cut(cm, width_cm, top))
    return (classed.filter("dbh_class IS NOT NULL").groupBy(*by, "dbh_class")
            .agg((F.count(F.lit(1)) * F.lit(K.TREES_PER_ACRE * K.ACRES_PER_HA_FINE))
                 .alias("trees_ha")))
