"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from standlab.operators.joins import match_nulls
from standlab.session import cut_lineage, small_side

FIVE = ["q0", "q25", "q50", "q75", "q100"]
PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def two_level(df: DataFrame, replicate: list[str], treatment: list[str], col: str,
              digits: int = 6) -> DataFrame:
    """Replicate means, then mean, deviation and range of those means."""
    means = df.groupBy(*replicate).agg(F.avg(col).alias("_m"))
    stats = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    return means.groupBy(*treatment).agg(
        *[F.round(fn("_m"), digits).alias(f"{name}_{col}") for name, fn in stats.items()])


def rounded_range(df: DataFrame, by: list[str], col: str, digits: int) -> DataFrame:
    out = df.groupBy(*by).agg(F.round(F.min(col), digits).alias(f"min_{col}"),
                              F.round(F.max(col), digits).alias(f"max_{col}"))
    width = F.col(f"max_{col}") - F.col(f"min_{col}")
    return out.withColumn(f"range_{col}", F.round(width, digits))


def five_number(df: DataFrame, by: list[str], col: str, continuous: bool = True) -> DataFrame:
    """Quartiles with linear interpolation, count and mean per group.

    ``continuous=False`` is for columns of few distinct values (codes, diameter classes):
    ``percentile`` then keeps a short value -> count table per group and one pass is enough.
    """
    if continuous:
        return exact_quantiles(df, by, col, dict(zip(FIVE, PROBS)))
    q = F.percentile(col, F.array(*[F.lit(p) for p in PROBS]))
    out = df.groupBy(*by).agg(F.count(col).alias("n"), F.round(F.avg(col), 6).alias("mean"),
                              q.alias("_q"))
    return out.select(*by, "n", "mean", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(FIVE)])


def exact_quantiles(df: DataFrame, by: list[str], col: str, probs: dict[str, float],
                    bins: int = 2048, few: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles without gathering a group in one place.

    Each wanted rank has a bracket, at first the group's whole range.  A round counts the rows of
    all brackets in ``bins`` even bins, and the bin that holds the rank becomes its bracket, from
    its smallest to its largest value: an outlier, however far, is left behind in one round, and a
    value that a third of all rows share ends up alone.  Brackets of at most ``few`` rows are
    ranked by their distinct values.  NaN counts as the largest value.  Without ``by``, one row.
    """
    if not by:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], col, probs, bins, few).drop("_all")
    rows = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x"))
    span = cut_lineage(rows.groupBy(*by).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("n"), F.round(F.avg("_x"), 6).alias("mean")))
    targets = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p"))
                        for name, p in probs.items()])
    state = cut_lineage(span.withColumn("_t", F.explode(targets))
                        .withColumn("_h", (F.col("n") - 1) * F.col("_t.p"))
                        .select(*by, F.col("_t.q").alias("_q"), "_h", "_lo", "_hi", F.col("n").alias("_n"),
                                F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))).alias("_rank"))
                        .withColumn("_k", F.col("_rank")))  # the rank within its bracket
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > few)
    while not state.filter(wide).isEmpty():
        state = cut_lineage(state.filter(~wide).unionByName(_narrowed(rows, state.filter(wide), by, bins)))
    alone, several = state.filter("_lo = _hi"), state.filter("_lo < _hi")
    at = [*by, "_lo", "_hi"]
    values = _cumulative(_inside(rows, several, by).groupBy(*at, "_x").agg(F.count(F.lit(1)).alias("_c")), at, "_x")
    ranked = match_nulls(several, values, at, "inner").filter("_k >= _from AND _k < _upto")
    found = alone.withColumn("_x", F.col("_lo")).select(*by, "_q", "_h", "_rank", "_x").unionByName(
        ranked.select(*by, "_q", "_h", "_rank", "_x"))
    near = F.col("_rank") == F.floor("_h")
    weight = F.when(near, 1.0 - (F.col("_h") - F.floor("_h"))).otherwise(F.col("_h") - F.floor("_h"))
    quantiles = found.groupBy(*by).pivot("_q", list(probs)).agg(F.sum(F.col("_x") * weight))
    return match_nulls(quantiles, span.select(*by, "n", "mean"), by, "inner")


def _cumulative(table: DataFrame, group: list[str], order: str) -> DataFrame:
    """Counts ``_c`` as places: a row of the table holds the ranks from _from to before _upto."""
    upto = F.sum("_c").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return table.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))


def _inside(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Rows within a bracket of their group, which are disjoint and at most two for each quantile."""
    lists = small_side(brackets.groupBy(*by).agg(F.collect_set(F.struct("_lo", "_hi")).alias("_in")))
    held = F.filter("_in", lambda r: (F.col("_x") >= r["_lo"]) & (F.col("_x") <= r["_hi"]))
    return (match_nulls(rows, lists, by, "inner").withColumn("_held", F.get(held, F.lit(0)))
            .filter("_held IS NOT NULL").select(*by, "_x", "_held._lo", "_held._hi"))


def _narrowed(rows: DataFrame, state: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Each rank's bin in its bracket; both ends have bins of their own, so every round gains."""
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    along = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)  # halves: the width itself may overflow
    along = F.coalesce(F.nanvl(along, F.lit(0.0)), F.lit(0.0))
    place = (F.when(x == lo, F.lit(0)).when(x == hi, F.lit(bins + 1))
             .otherwise(1 + F.least(F.floor(along * bins), F.lit(bins - 1))))
    at = [*by, "_lo", "_hi"]
    counts = _inside(rows, state, by).groupBy(*at, place.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    hit = match_nulls(state, _cumulative(counts, at, "_bin"), at, "inner").filter("_k >= _from AND _k < _upto")
    return hit.select(*by, "_q", "_h", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"),
                      F.col("_c").alias("_n"), "_rank", (F.col("_k") - F.col("_from")).alias("_k"))
