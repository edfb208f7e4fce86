"""Reading the parquet tables, and the two rules that hold for each of them: current row and same id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref_key(col: Column | str) -> Column:
    """A reference as it compares: no letter case, no white space around it; blank is null."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(bare != "", bare)


def current_rows(df: DataFrame, keys: list[str] | str = "id", version: str = "updated_at", ties: list[str] | None = None) -> DataFrame:
    """The row with the greatest version of each key.

    Rows of a null key are dropped, a null version is the oldest, and rows that tie in the version are
    told apart by the other columns (``ties``, by default all that can be ordered), so that the result
    doesn't depend on the order of the input. Exact repeats collapse to one row.

    One shuffle by key and one sort; the sort is the window's, so a key with very many rows streams
    through it and isn't held in memory.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if ties is None:
        ties = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant") and f.name not in (*keys, version)]
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ties))
    held = df.where(F.col(keys[-1]).isNotNull()).repartition(*keys)
    return held.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer partitions than there are, as a small single file does.

    Only an input of less than a partition's bytes for each core is ever moved; a large one already has
    more partitions than cores and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
