"""Problem 3: the most similar vectors of every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.neighbors import nearest
from tessera.sources.tables import read_table, spread

DIMS = 64
RECALL = 0.96  #: Of the five nearest without a least cosine, as laid out.


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "knowledge_chunks").where("stale_at is null").select("id", "embedding"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(_chunks(spark, sf_dir), 5, DIMS, least_cosine=0.9)
    return near.select(F.least("id", "neighbor_id").alias("chunk_id_a"), F.greatest("id", "neighbor_id").alias("chunk_id_b")).distinct()


def p3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every chunk whose id, its last eight hexadecimal digits as a number, is divisible by 50."""
    asked = F.conv(F.substring("id", -8, 8), 16, 10).cast("long") % 50 == 0
    return nearest(_chunks(spark, sf_dir), 5, DIMS, recall=RECALL, queries=asked)


QUERIES = {f.__name__: f for f in (p3_found, p3_neighbors)}
SQL = {
    "p3_found": """
with v as (select distinct id, embedding::double[64] as e from knowledge_chunks where stale_at is null and len(embedding) = 64
           and list_aggregate(list_transform(embedding, lambda x: (isfinite(x))::int), 'min') = 1 and list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
ranked as (select a.id as x, b.id as y, array_cosine_similarity(a.e, b.e) as c, row_number() over (partition by a.id order by array_cosine_similarity(a.e, b.e) desc, b.id) as r from v a join v b on a.id <> b.id)
select distinct least(x, y) as chunk_id_a, greatest(x, y) as chunk_id_b from ranked where r <= 5 and c >= 0.9""",
}
