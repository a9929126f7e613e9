"""Session helpers: shared work folder, lineage cuts, small literal tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SMALL_ROWS = 10_000  # summary tables up to this many rows are broadcast


def prepare(spark: SparkSession) -> SparkSession:
    """Let Spark split a hot key's join partition even where that costs another shuffle."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, a folder inside the
    session's own warehouse serves, which all executors share too.  No setting is changed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/standlab-work"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iteration's state as a table in the shared folder and go on from there.

    A table survives the loss of executors, and reading it back gives the next plan the
    state's true size; size estimates carried through repeated joins would only grow.
    """
    path = scratch_path(df.sparkSession, "state")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_ids(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for narrow rows of ids: one task writes some partitions, as most are next to empty."""
    return cut_lineage(df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)))


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A summary table about to be joined to raw rows, written out and counted first.

    Few rows: broadcast, so the raw rows are not shuffled by a key with few values.
    Otherwise the table is returned as it is, for an ordinary join.
    """
    table = cut_lineage(df)
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for an exported table."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small inline table whose size the optimizer knows, so joins to it broadcast."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]

    def cell(value, kind):
        if value is None:
            return f"CAST(NULL AS {kind})"
        if isinstance(value, float) and (value != value or abs(value) == float("inf")):
            return f"CAST('{value}' AS {kind})"
        text = "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else repr(value)
        return f"CAST({text} AS {kind})"

    values = ", ".join(
        "(" + ", ".join(cell(v, kind) for v, (_, kind) in zip(row, fields)) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
