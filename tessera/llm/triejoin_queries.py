"""Problem 1: near-duplicate records with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.triejoin import near_duplicate_groups, shingle_sets, similar_pairs, similar_sets
from tessera.sources.tables import current_rows, read_table, spread


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current pages that aren't deleted, with title and text together."""
    pages = spread(read_table(spark, sf_dir, "pages").select("id", "title", "text_content", "updated_at", "deleted_at"))
    live = current_rows(pages).where("deleted_at is null")
    return live.select("id", "text_content", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text_content", F.lit(""))).alias("whole"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = similar_sets(shingle_sets(_pages(spark, sf_dir), "id", "whole", 3, 20, "text_content"), 0.6)
    return similar_pairs(members, links).select(F.col("key_a").alias("page_id_a"), F.col("key_b").alias("page_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of pages by shingles of five words and a similarity of 0.8; every live page has a row.

    A null title or text counts as empty. Pages of fewer than five words are only like those of the same words.
    """
    members, links = similar_sets(shingle_sets(_pages(spark, sf_dir), "id", "whole", 5, short=True), 0.8)
    return near_duplicate_groups(members, links).withColumnRenamed("key", "page_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups)}

_LIVE = r"""
with cur as (select distinct on (id) * from pages order by id, updated_at desc),
doc as (select id, regexp_extract_all(regexp_replace(lower(text_content), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+') as body,
        regexp_extract_all(regexp_replace(lower(coalesce(title, '') || ' ' || text_content), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+') as w
        from cur where deleted_at is null and text_content is not null),
"""
SQL = {
    "p1_found": _LIVE + """
g as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from doc where len(body) >= 20),
n as (select id, count(*) as n from g group by id)
select a.id as page_id_a, b.id as page_id_b from g a join g b on a.s = b.s and a.id < b.id join n na on na.id = a.id join n nb on nb.id = b.id
group by a.id, b.id, na.n, nb.n having count(*) >= 0.6 * (na.n + nb.n - count(*))""",
}
