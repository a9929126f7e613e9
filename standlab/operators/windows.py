"""Per-plot shares, running totals and top-k.

A plot may hold a large part of all trees, so nothing here sends the raw rows of
one plot to a single task: totals are pre-aggregated and joined back, top-k works on
collapsed diameters, and running totals add up over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from standlab.operators.joins import match_nulls
from standlab.session import cut_lineage, small_side


def species_share(df: DataFrame, plot: list[str], spp: str = "spp") -> DataFrame:
    """Share of each species in the plot's tree count."""
    counts = df.groupBy(*plot, spp).agg(F.count(F.lit(1)).alias("tree_ct"))
    total = F.sum("tree_ct").over(W.partitionBy(*plot))
    return (counts.withColumn("t_trees", total)
            .withColumn("proportion", F.col("tree_ct") / F.col("t_trees")))


def with_group_total(df: DataFrame, by: list[str], **totals: Column) -> DataFrame:
    """Carry group aggregates on every row: aggregate map-side, then join back."""
    table = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in totals.items()])
    return match_nulls(df, table, by)


def top_mean(df: DataFrame, by: list[str], order: str, value: str, n: int,
             out: str = "top_mean") -> DataFrame:
    """Mean of ``value`` over the n largest by ``order``, ties at the n-th kept.

    Rows collapse to one per distinct ``order`` first; a class belongs to the top n
    exactly when fewer than n rows are larger.  As every class has a row, only the n
    highest classes can, so every task passes on no more than these.
    """
    classes = df.filter(F.col(order).isNotNull()).groupBy(*by, order).agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_nv"), F.sum(value).alias("_sv"))
    descending = W.partitionBy(*by).orderBy(F.desc(order))
    larger = descending.rowsBetween(W.unboundedPreceding, -1)
    return (classes.withColumn("_place", F.row_number().over(descending)).filter(F.col("_place") <= n)
            .withColumn("_before", F.coalesce(F.sum("_n").over(larger), F.lit(0)))
            .filter(F.col("_before") < n)
            .groupBy(*by)
            .agg((F.sum("_sv") / F.sum("_nv")).alias(out), F.sum("_n").alias("n_top")))


def sums_before(df: DataFrame, by: list[str], specs: dict[str, tuple[str, Column]], tie: str) -> DataFrame:
    """Exclusive running sums in descending order, 0 for the first row of a group.

    ``specs`` maps an output name to (order column, measure); ties in the order column follow
    ``tie``, which is unique within a group.  Rows without an order value come last, null keys
    are a group.
    """
    for name, (order, measure) in specs.items():
        df = _sum_before(df, by, order, measure, tie, name)
    return df


def _sum_before(df, by, order, measure, tie, name):
    """Prefix sum over range partitions of (group, order descending, tie), which hold about as many
    rows each, however large a group and however equal its values: the sum within a partition
    plus the totals of the group's partitions before it."""
    ranged = df.withColumn("_m", measure).repartitionByRange(*by, F.desc(order), F.asc(tie))
    dealt = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    group = W.partitionBy(*by)
    before = F.sum("_total").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    # only a group that an edge of a partition cuts has several: fewer rows than twice the partitions
    offsets = small_side(dealt.groupBy(*by, "_part").agg(F.sum("_m").alias("_total"))
                         .withColumn("_parts", F.count(F.lit(1)).over(group))
                         .withColumn("_offset", before).filter("_parts > 1").select(*by, "_part", "_offset"))
    within = W.partitionBy(*by, "_part").orderBy(F.desc(order), tie).rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.withColumn("_sum", F.coalesce(F.sum("_m").over(within), F.lit(0.0)))
    total = F.col("_sum") + F.coalesce("_offset", F.lit(0.0))
    return match_nulls(rows, offsets, [*by, "_part"]).select(*[F.col(f"`{c}`") for c in df.columns], total.alias(name))


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """Sorted head: Spark keeps n rows per task and merges them."""
    return df.orderBy(*order).limit(n)
