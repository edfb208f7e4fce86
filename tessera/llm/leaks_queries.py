"""Problem 6: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.leaks import leaked_items
from tessera.sources.tables import read_table, spread


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), read_table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item, how many documents hold part of it and how many all of it."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_windows") == F.col("item_windows")).alias("n_whole"))


QUERIES = {f.__name__: f for f in (p6_found, p6_items)}
SQL: dict[str, str] = {}
