"""Problem 7: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.mixing import mix
from tessera.sources.tables import read_table, spread


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")), read_table(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


QUERIES = {f.__name__: f for f in (p7_selection, p7_shares)}
SQL: dict[str, str] = {}
