"""Cleaning operators over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, FloatType

from standlab.functions import columns as C


def clean_names(df: DataFrame) -> DataFrame:
    """Lower-case names without a byte-order mark, dots or quotes; empty names get a number."""
    out, seen = [], set()
    for i, name in enumerate(df.columns):
        base = re.sub(r"[^0-9a-z]+", "_", name.replace("﻿", "").lower()).strip("_") or f"x{i}"
        while base in seen:
            base += "_"
        seen.add(base)
        out.append(base)
    return df.toDF(*out)


def dedupe_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in an explicit order, with all its columns.

    The ``= 1`` filter lets Spark keep one candidate per key in every map task, so a
    key repeated any number of times reaches the shuffle as a few rows.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def exclude_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop rows whose values match a listed combination."""
    return df.join(pairs, pairs.columns, "left_anti")


def fill_null(df: DataFrame, value, cols: list[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=cols)


def drop_sentinel(df: DataFrame, col: str) -> DataFrame:
    """Null -> out-of-range marker -> filter amounts to a not-null filter."""
    return df.filter(F.col(col).isNotNull())


def drop_null_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def finite_only(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        df = df.filter(C.is_finite(c))
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: C.nan_to_null(c) for c in floats})


def impute(df: DataFrame, col: str, predicted, out: str, flag: str | None = None,
           missing: Column | None = None) -> DataFrame:
    """Measured value where there is one, else the prediction, with an imputed flag."""
    measured = F.col(col)
    gap = measured.isNull() if missing is None else missing
    fill = F.col(predicted) if isinstance(predicted, str) else predicted
    added = {out: F.when(gap, fill).otherwise(measured)}
    if flag:
        added[flag] = F.coalesce(gap, F.lit(True)).cast("int")
    return df.withColumns(added)


def null_audit(df: DataFrame) -> DataFrame:
    """One row per column: how many nulls, out of how many rows."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count(c).alias(c) for c in df.columns])
    return (counts.unpivot("_rows", df.columns, "column_name", "present")
            .select("column_name", (F.col("_rows") - F.col("present")).alias("n_null"),
                    F.col("_rows").alias("n_rows")))


def suffix(df: DataFrame, cols: list[str], text: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + text for c in cols})


def select_at(df: DataFrame, positions: list[int]) -> DataFrame:
    """Columns by 1-based position, resolved to names before planning."""
    return df.select(*[df.columns[i - 1] for i in positions])
