"""Problem 8: visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.charfold import look_alike_classes, look_alike_keys, look_alike_pairs, normalize_text
from tessera.sources.tables import read_table, spread


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(look_alike_keys(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id"), "doc_id")


def p8_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_text(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_classes(look_alike_keys(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id"), "doc_id")


QUERIES = {f.__name__: f for f in (p8_found, p8_normalized, p8_classes)}
SQL: dict[str, str] = {}
