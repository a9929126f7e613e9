"""Stages that turn raw documents into training data, each written as Parquet before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from standlab.llm import bpe, decontaminate, ngram_join, quality, substring_dedup
from standlab.llm.tables import ready, table
from standlab.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents selected by importance resampling against the texts labelled good."""
    chosen = quality.resample(docs, table(spark, sf_dir, "labels"))
    return chosen.filter("selected").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    ready(spark)
    return ngram_join.one_per_component(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words and more that occur elsewhere; no document goes."""
    ready(spark)
    cut = substring_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(
        F.col("n_chars"))).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    ready(spark)
    coded = docs.withColumn("_coded", bpe.coder(spark, bpe.tokenizer_path())("text"))
    return coded.select("doc_id", "lang", "source", "_coded.n_tokens", "_coded.ids", "_coded.decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("bpe", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
