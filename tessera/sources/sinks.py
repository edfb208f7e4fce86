"""Writes that replace what they concern and leave the rest: upsert by key, replacement of one part's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import first_rows


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows whose key has no new row, and of each key's new rows the last in ``order``."""
    last = first_rows(new, keys, [F.col(order).desc_nulls_last()])
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def replaced(old: DataFrame, new: DataFrame, part: list[str], parts: DataFrame) -> DataFrame:
    """Old rows of all parts but the given, and the new rows; a given part without new rows ends empty."""
    return old.join(parts.select(*part).distinct(), part, "left_anti").unionByName(new)


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """Overwrite only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
