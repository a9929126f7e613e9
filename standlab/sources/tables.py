"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from standlab.operators.clean import clean_names


def _struct(text: str) -> StructType:
    kinds = {"s": StringType(), "i": IntegerType(), "l": LongType(), "d": DoubleType()}
    return StructType([StructField(n, kinds[k]) for n, k in
                       (item.split(":") for item in text.split())])


# fixed values: column names and types of the input tables, in file order
SCHEMAS = {
    "trees": _struct("block:s plot:l tree:s spp:s code:s status:i dbh:d ht:d hcb:d "
                     "llb_ht:d lai:d"),
    "stemform": _struct("block:s plot:l tree:s spp:s dam1:s deduct1:i dam2:s deduct2:i "
                        "dam3:s deduct3:i t_deduct:i"),
    "plots": _struct("block:s plot:l code:s descr:s"),
    "site": _struct(
        "block:s plot:l uid:s bs_suitability:d ws_suitability:d rs_suitability:d elevation:d "
        "tri:d tpi:d roughness:d slope:d aspect:d flowdir:i tmin:d tmean:d tmax:d dew:d "
        "vpdmax:d vpdmin:d mcnab:d bolstad:d profile:d planform:d winds10:d winds50:d swi:d "
        "rad:d ppt:d parent:i densic:d lithic:d redox:d min_depth:d wd2000:d wd2020:d whc:d "
        "ex_mg:d ex_ca:d ph:d dep:d ex_k:d nit:d swc2:d meanwd:d set:s"),
    "inventory": _struct("mu:s inv:i plot:l tree_id:s tree_num:i species:i year:i dbh:d "
                         "expf:d mort:i harv:i ingrowth:i"),
    "heights": _struct("mu:s inv:i plot:l tree_num:i ht:d blc:d"),
    "species": _struct("species:i model_species:s"),
    "early_trees": _struct("block:s plot:l spp:s dbh:d ht:d"),
}


def load_table(spark: SparkSession, path: str, kind: str | None = None,
               schema: StructType | None = None) -> DataFrame:
    """Read CSV or Parquet with a declared schema.

    In CSV, ``NA`` is null; a blank is null in a numeric column and an empty string in a text
    column; a number that does not parse becomes null.
    """
    schema = schema or (SCHEMAS[kind] if kind else None)
    if path.rstrip("/").endswith(".parquet"):
        return clean_names(spark.read.parquet(path))
    if schema is None:
        raise ValueError("CSV needs a schema; inferring one costs a pass over the data")
    text = StructType([StructField(f.name, StringType()) for f in schema])
    raw = (spark.read.schema(text).option("header", True).option("nullValue", "\u0001")
           .option("emptyValue", "").option("enforceSchema", True).csv(path))
    raw = raw.fillna("", subset=[f.name for f in schema]).replace("NA", None)
    return raw.select(*[
        raw[f.name] if isinstance(f.dataType, StringType)
        else raw[f.name].try_cast(f.dataType).alias(f.name) for f in schema])


def load_cells(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    """Raster stack kept as a cell table (row, col, one column per band)."""
    df = spark.read.parquet(path)
    if bands:
        keys = ["row", "col"]
        old = [c for c in df.columns if c not in keys and c != "tile"]
        df = df.withColumnsRenamed(dict(zip(old, bands, strict=True)))
    return df


def write_summary(df: DataFrame, path: str, fmt: str = "parquet", by: str = "block") -> None:
    """Summary table partitioned by block."""
    writer = df.write.mode("errorifexists").partitionBy(by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_cells(df: DataFrame, path: str, tile: int = 1024) -> None:
    """Cell stack partitioned by square tile, so a window of cells reads few files."""
    from pyspark.sql import functions as F

    edge = F.concat_ws("_", F.floor(F.col("row") / tile), F.floor(F.col("col") / tile))
    (df.withColumn("tile", edge).repartition("tile")
     .write.mode("errorifexists").partitionBy("tile").parquet(path))
