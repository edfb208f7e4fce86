"""Hybrid retrieval: lexical, dense and title recall, fusion by reciprocal ranks, relevance, expansion, packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import informative_terms, search_tokens, title_key
from tessera.functions.vectors import cosine

K1, B = 1.5, 0.75  #: BM25's saturation and length normalisation.
RRF_K = 60
MOST_DISTANT = 0.45  #: Beyond this cosine distance a dense hit needs a common term.


def bm25(docs: DataFrame, key: str, text: str, query: list[str], limit: int) -> DataFrame:
    """(key, score, rank) of the best documents. Repeated terms of the query count repeatedly.

    Only the query's terms are counted: each document becomes one row of its length and its term counts, so
    nothing is exploded or shuffled but the query's statistics, one row, and the best rows of each partition.
    """
    terms = sorted(set(query))
    tokens = docs.select(key, search_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    tf = [(F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(terms)]
    rows = tokens.select(key, F.size("t").alias("n"), *tf)
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        idf = F.log(1 + (F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score += query.count(w) * idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("n") / F.col("avgdl")))
    ranked = rows.crossJoin(F.broadcast(stats)).select(key, F.round(score, 6).alias("score")).where("score > 0")  # stats is one row
    return _ranked(ranked, key, [F.col("score").desc(), F.col(key)], limit)


def _ranked(df: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows in the order, numbered; only these enter the window."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def dense_topk(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int) -> DataFrame:
    """(key, distance, rank) by exact cosine distance; vectors of another length aren't candidates."""
    at = F.array(*map(F.lit, query))
    rows = vectors.where(F.size(vector) == len(query)).select(key, F.round(1 - cosine(F.col(vector), at), 6).alias("distance"))
    return _ranked(rows, key, [F.col("distance"), F.col(key)], limit)


def title_recall(docs: DataFrame, key: str, title: str, query: str, limit: int) -> DataFrame:
    """(key, score, rank): 1 where the folded title is the query's, 0.5 where one holds the other."""
    t, q = title_key(F.col(title)), title_key(F.lit(query))
    score = F.when(t == q, 1.0).when((F.length(t) >= 2) & (F.contains(q, t) | F.contains(t, q)), 0.5)
    return _ranked(docs.where(F.col(title).isNotNull()).select(key, score.alias("score")).where("score is not null"), key, [F.col("score").desc(), F.col(key)], limit)


def fuse(lists: dict[str, DataFrame], key: str, limit: int, k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, score, signals, rank): the sum over the lists of weight / (k + rank); ties by signal, then key.

    lists: by signal ('exact-title', 'semantic', 'lexical', 'graph-neighbor'), each with key and rank.
    """
    weights = weights or {}
    rows = None
    for signal, df in lists.items():
        part = df.select(key, F.lit(signal).alias("signal"), (F.lit(weights.get(signal, 1.0)) / (k + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    priority = F.max(F.when(F.col("signal") == "exact-title", 3).when(F.col("signal") == "semantic", 2).when(F.col("signal").isin("graph-neighbor", "lexical"), 1).otherwise(0))
    merged = rows.groupBy(key).agg(F.round(F.sum("s"), 9).alias("score"), F.array_sort(F.collect_set("signal")).alias("signals"), priority.alias("priority"))
    return _ranked(merged, key, [F.col("score").desc(), F.col("priority").desc(), F.col(key)], limit).drop("priority")


def relevant(fused: DataFrame, texts: DataFrame, key: str, text: str, query: str, distances: DataFrame) -> DataFrame:
    """Fused rows that a title or lexical hit vouches for, or a dense hit that is near or shares a term.

    It filters what was fused and cut to its limit before, so that fewer rows than the limit may remain.
    """
    both = fused.join(texts.select(key, text), key, "left").join(distances.select(key, "distance"), key, "left")
    shared = F.arrays_overlap(informative_terms(F.coalesce(text, F.lit(""))), informative_terms(F.lit(query)))
    has = lambda s: F.array_contains("signals", s)
    ok = has("exact-title") | has("lexical") | (has("semantic") & (shared | F.col("distance").isNull() | (F.col("distance") <= MOST_DISTANT)))
    return both.where(F.coalesce(ok, F.lit(False))).select(*fused.columns)


def expand_graph(seeds: DataFrame, edges: DataFrame, hops: int = 2, limit: int | None = None) -> DataFrame:
    """(node, hop, score): what is reached within ``hops`` steps, in both directions, without the seeds.

    edges: a, b, weight. A node has the hop at which it is first reached, and of that hop the largest
    weight / hop.
    """
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).where("a != b")
    seen, front, out = seeds.select("node").distinct(), seeds.select("node").distinct(), None
    for hop in range(1, hops + 1):
        step = both.join(front.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max(F.col("weight") / hop).alias("score"))
        found = step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        out = found if out is None else out.unionByName(found)
        front = found.select("node")
        seen = seen.unionByName(front)
    out = out.select("node", "hop", F.round("score", 6).alias("score"))
    return out.orderBy(F.col("score").desc(), "node").limit(limit) if limit else out


def pack_context(items: DataFrame, group: str, rank: str, body: str, budget: int, most: int) -> DataFrame:
    """(group, rank, packed): bodies in order of rank, each clipped to ``most`` characters and to what is left of the budget.

    A body takes min(length, most) as long as that is left, so what is left before each is the budget less a
    running sum, and only the one that crosses the budget is clipped by it. ``rank`` is unique in its group.
    """
    # The window sees lengths only, and no more rows of a group than characters of the budget; texts join what is left.
    sizes = items.where(F.length(body) > 0).select(group, rank, F.least(F.length(body), F.lit(most)).alias("__want"))
    w = Window.partitionBy(group).orderBy(rank)
    first = sizes.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= budget)
    before = F.coalesce(F.sum("__want").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = first.withColumn("__left", F.lit(budget) - before).where("__left > 0").select(group, rank, F.least("__want", "__left").cast("int").alias("__take"))
    return items.select(group, rank, body).join(placed, [group, rank]).select(group, rank, F.substring(F.col(body), F.lit(1), F.col("__take")).alias("packed"))
