"""Reshaping operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stack_samples(samples: dict[str, DataFrame], label: str = "sample") -> DataFrame:
    """Rows of several samples on top of each other, labelled."""
    out = None
    for name, df in samples.items():
        tagged = df.withColumn(label, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def widen(df: DataFrame, keys: list[str], names: str, value: str, levels: list[str],
          suffix: str = "", agg=F.first, fill: float | None = 0.0) -> DataFrame:
    """Long to wide over known levels (an unknown list would cost an extra job)."""
    wide = df.groupBy(*keys).pivot(names, levels).agg(agg(value))
    if fill is not None:
        wide = wide.fillna(fill, subset=levels)
    return wide.withColumnsRenamed({lv: lv + suffix for lv in levels}) if suffix else wide


def lengthen(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, cols, name, value)
