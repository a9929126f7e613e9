"""Tables, batches and intermediate state that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from standlab.session import cut_ids, prepare


def ready(spark: SparkSession) -> SparkSession:
    """Batches sent to Python hold some megabytes, however long their texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


SLOTS = 1 << 20  # hashed ids that are broadcast at most


def _slot(column):
    return F.pmod(F.xxhash64(column), F.lit(SLOTS))


def near_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of the ids, and a few others: a semi-join by SLOTS hashed
    ids, which bounds what is broadcast and spares the texts a shuffle."""
    slots = ids.select(_slot("doc_id").alias("_slot")).distinct()
    return docs.join(F.broadcast(slots), _slot("doc_id") == F.col("_slot"), "left_semi")


def off_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_ids`` leaves."""
    slots = ids.select(_slot("doc_id").alias("_slot")).distinct()
    return docs.join(F.broadcast(slots), _slot("doc_id") == F.col("_slot"), "left_anti")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with none of the ids; a row without doc_id stays.

    Rows whose hashed id is free of them pass by; only the others are shuffled for the exact test.
    """
    met = near_ids(docs, ids).join(ids, "doc_id", "left_anti").select(docs.columns)
    return off_ids(docs, ids).unionByName(met)


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable over links (a, b), for every node that is not the smallest itself.

    Each round points every
    node at the smallest node among its neighbours (large star), then every chain one step
    further (small star); both keep the components and end in stars.  State is written as a
    table each round, so a lost executor costs one round at most.
    """
    edges = cut_ids(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct())
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                         F.col("m").alias("b")).filter("a <> b").distinct())
        new = cut_ids(small)
        if _same(edges, new):
            return new.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = new


def _same(old: DataFrame, new: DataFrame) -> bool:
    def key(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return key(old) == key(new)
