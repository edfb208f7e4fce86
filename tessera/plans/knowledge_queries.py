"""Retrieval, trees, permissions, graph, compilation and incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import error_message, informative_terms, sha, stable_uuid, title_key, trigram_similarity, trigrams
from tessera.functions.vectors import cosine
from tessera.operators import acl, compilation, graph, incremental, retrieval
from tessera.operators.hierarchy import hierarchy, inherited_marks, page_nodes, paths
from tessera.operators.relational import divides, first_rows
from tessera.plans.listing_queries import CUR, KEY, RUN_PAGES, current, live_pages
from tessera.session import Workspace
from tessera.sources.tables import current_rows, read_table, ref_key, spread

QUERY = ["draft", "page", "locked", "page"]


# Retrieval

def _docs(spark, d) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "title", "text"))


def bm25_topk(spark, d):
    return retrieval.bm25(_docs(spark, d), "doc_id", "text", QUERY, 20)


def _vectors(spark, d) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


AT = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]  #: a query vector


def dense_topk_cosine(spark, d):
    return retrieval.dense_topk(_vectors(spark, d), "doc_id", "embedding", AT, 20)


def title_hits(spark, d):
    return retrieval.title_recall(_docs(spark, d), "doc_id", "title", "the Outline", 20)


def _lists(spark, d) -> dict[str, DataFrame]:
    return {"lexical": bm25_topk(spark, d), "semantic": dense_topk_cosine(spark, d), "exact-title": title_hits(spark, d)}


def hybrid_rrf(spark, d):
    return retrieval.fuse({k: v.select("doc_id", "rank") for k, v in _lists(spark, d).items()}, "doc_id", 20).select("doc_id", "score", F.concat_ws(",", "signals").alias("signals"), "rank")


def hybrid_relevant(spark, d):
    lists = _lists(spark, d)
    fused = retrieval.fuse({k: v.select("doc_id", "rank") for k, v in lists.items()}, "doc_id", 20)
    return retrieval.relevant(fused, _docs(spark, d), "doc_id", "text", " ".join(QUERY), lists["semantic"]).select("doc_id", "rank")


def trigram_titles(spark, d):
    """Part names like a given one, by shared trigrams."""
    p = read_table(spark, d, "part").select("p_partkey", "p_name")
    s = F.round(trigram_similarity(trigrams("p_name"), trigrams(F.lit("blue widget"))), 6)
    return p.select("p_partkey", s.alias("similarity")).where("similarity > 0.15")


def context_pack(spark, d):
    """Texts of each space in order of time, clipped to 500 characters each and 3 000 in all."""
    t = read_table(spark, d, "documents").where("space_id is not null and text is not null").select("doc_id", "space_id", "text")
    packed = retrieval.pack_context(t, "space_id", "doc_id", "text", 3000, 500)
    return packed.select("space_id", "doc_id", F.length("packed").alias("n"), F.md5("packed").alias("digest"))


def catalog_candidates(spark, d):
    """Branches of signals in one union, with what each says and the best score."""
    o = read_table(spark, d, "lineitem")
    arm = lambda cond, name, score: o.where(cond).select(F.col("l_partkey").alias("k"), F.lit(name).alias("s"), score.alias("v"))
    u = arm("l_returnflag = 'R'", "returned", F.col("l_quantity")).union(arm("l_discount >= 0.09", "cheap", F.col("l_discount") * 100)).union(arm("l_quantity > 45", "bulk", F.col("l_quantity") / 2))
    g = u.groupBy("k").agg(F.bool_or(F.col("s") == "returned").alias("returned"), F.bool_or(F.col("s") == "cheap").alias("cheap"), F.bool_or(F.col("s") == "bulk").alias("bulk"), F.round(F.max("v"), 4).alias("score"))
    return g.orderBy(F.col("score").desc(), "k").limit(512)


# Trees and permissions

def closure_of(spark, d, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The hierarchy of pages, and (page_id, ancestor_id, depth) with each page itself at depth 0."""
    tree = ws.table(hierarchy(page_nodes(read_table(spark, d, "pages")), ws), "tree")
    p = paths(tree).select(F.col("id").alias("page_id"), F.posexplode("path").alias("i", "ancestor_id"), F.size("path").alias("n"))
    return tree, ws.table(p.select("page_id", "ancestor_id", (F.col("n") - 1 - F.col("i")).alias("depth")), "closure")


def tree_closure(spark, d):
    return closure_of(spark, d, Workspace(spark))[1]


def tree_of(spark, d) -> DataFrame:
    ws = Workspace(spark)
    return ws.table(hierarchy(page_nodes(read_table(spark, d, "pages")), ws), "tree")


def breadcrumbs(spark, d):
    """Each page's titles from the root down."""
    titles = current(spark, d, "pages", "title").select("id", F.coalesce("title", F.lit("untitled")).alias("title"))
    return paths(tree_of(spark, d).join(titles, "id"), label="title").select(F.col("id").alias("page_id"), F.concat_ws(" > ", "path").alias("crumbs"))


def _marked(spark, d, tree: DataFrame, flag: str) -> DataFrame:
    """The pages for which a condition on current rows holds, or holds for a page above."""
    rows = current(spark, d, "pages", "is_locked", "deleted_at").where(flag)
    return inherited_marks(tree, rows.select("id", F.col("id").alias("name"), F.lit(True).alias("every"), F.lit(True).alias("nearest")))


def pruned_descent(spark, d):
    """Pages reached from the roots without passing a locked page; a locked page isn't reached itself."""
    tree = tree_of(spark, d)
    return tree.where("status = 'tree'").select("id").join(_marked(spark, d, tree, "is_locked").select("id"), "id", "left_anti").select(F.col("id").alias("page_id"))


def export_names(spark, d):
    """Names of files for export: siblings of one title are told apart as 't', 't (1)', 't (2)'."""
    p = live_pages(spark, d, "title", "parent_page_id", "position").withColumn("parent", F.coalesce(ref_key("parent_page_id"), F.lit(""))).withColumn("t", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("untitled")))
    k = F.row_number().over(Window.partitionBy("parent", "t").orderBy(F.col("position").asc_nulls_first(), "id")) - 1
    return p.withColumn("k", k).select("id", F.when(F.col("k") == 0, F.col("t")).otherwise(F.concat("t", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).alias("name"))


def retention_purge(spark, d):
    """Pages deleted more than 30 days before a given day, with all their descendants."""
    return _marked(spark, d, tree_of(spark, d), "deleted_at < timestamp_ntz'2026-03-01' - interval 30 days").select(F.col("id").alias("page_id"))


def _access(spark, d) -> tuple[DataFrame, DataFrame]:
    """Restrictions of pages, and who is granted them."""
    access = current(spark, d, "page_access", "page_id").withColumn("page_id", ref_key("page_id"))
    granted = acl.principals(current(spark, d, "page_permissions", "page_access_id", "user_id", "group_id", "role").withColumn("page_access_id", ref_key("page_access_id")))
    return access, granted


def _who(spark, d) -> list[str]:
    """One user and one group, the smallest ids: two values."""
    p = read_table(spark, d, "page_permissions")
    u, g = p.agg(F.min("user_id"), F.min("group_id")).first()
    return [f"u:{u}", f"g:{g}"]


def acl_access(spark, d):
    return acl.page_access(tree_of(spark, d), acl.restrictions(*_access(spark, d), _who(spark, d)))


def acl_nearest(spark, d):
    return acl.nearest_restriction(tree_of(spark, d), acl.restrictions(*_access(spark, d), []))


def acl_readers(spark, d):
    """Who may read the pages below each restriction. Users count as members of the groups that share a restriction of theirs."""
    access, granted = _access(spark, d)
    ws = Workspace(spark)
    tree, granted = tree_of(spark, d), ws.table(granted.distinct(), "granted")
    marks = ws.table(acl.restrictions(access, granted, []), "marks")
    # Of each restricted page, the restricted pages at and above it: only these paths are made.
    t = tree.join(marks.select("id", "name"), "id")
    above = paths(t).join(marks.select("id", "name"), "id").select(F.col("name").alias("page_access_id"), F.explode("path").alias("page_id"))
    pairs = [granted.where(f"principal like '{k}:%'").select("page_access_id", F.substring("principal", 3, 1000).alias(c)) for k, c in (("u", "user_id"), ("g", "group_id"))]
    members = pairs[0].join(pairs[1], "page_access_id").select("user_id", "group_id").distinct()
    return acl.readers(above, access, granted, members)


def restricted_subtree(spark, d):
    """Pages of the five largest trees that some restriction holds for, their own or one above."""
    tree = tree_of(spark, d)
    roots = tree.where("depth = 0").orderBy(F.col("n_descendants").desc(), "id").limit(5).select("root_id")
    some = tree.join(F.broadcast(roots), "root_id", "left_semi")  # five rows
    return acl.nearest_restriction(some, acl.restrictions(*_access(spark, d), [])).select("page_id")


def share_lookup(spark, d):
    """The nearest page at or above each page that is locked, which stands for a shared one, and how far up it is."""
    tree = tree_of(spark, d)
    return _marked(spark, d, tree, "is_locked").select(F.col("id").alias("page_id"), F.col("name").alias("share_page_id"), F.col("distance").alias("level"))


def acl_chunks(spark, d):
    """Chunks whose page, and with it every restriction above, is readable."""
    lineage = read_table(spark, d, "knowledge_chunks").where("stale_at is null").select(F.col("id").alias("chunk_id"), ref_key("knowledge_page_id").alias("page_id"))
    return acl.readable_chunks(lineage, acl_access(spark, d))


def readable_parents(spark, d):
    """Parents with at least one readable child."""
    ok = acl_access(spark, d).where("can_read").select(F.col("page_id").alias("id"))
    kids = live_pages(spark, d, "parent_page_id").withColumn("parent_id", ref_key("parent_page_id")).where("parent_id is not null")
    return kids.join(ok, "id", "left_semi").select("parent_id").distinct()


def full_coverage(spark, d):
    """Runs of which every page succeeded at least once."""
    rows = current(spark, d, RUN_PAGES, "run_id", "source_page_id", "status").withColumn("run_id", ref_key("run_id")).where("run_id is not null")
    return divides(rows, rows.where("status = 'succeeded'"), ["run_id"], ["source_page_id"])


# Graph: parts and suppliers as nodes and sources

def _supplies(spark, d) -> DataFrame:
    return read_table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


def _edges(spark, d) -> DataFrame:
    """Parent links of pages."""
    return current(spark, d, "pages", "parent_page_id").select(F.col("id").alias("a"), ref_key("parent_page_id").alias("b")).where("b is not null")


def _runs_of_pages(spark, d) -> DataFrame:
    return current(spark, d, RUN_PAGES, "run_id", "source_page_id").select(ref_key("run_id").alias("r"), ref_key("source_page_id").alias("p"))


def shared_source_edges(spark, d):
    """Pages that were attached or compiled from the same run: how many runs both have."""
    return graph.shared_source_pairs(_runs_of_pages(spark, d), "p", "r")


def adamic_adar(spark, d):
    return graph.adamic_adar(_edges(spark, d))


def derived_edges(spark, d):
    return graph.edges_of_sources(_runs_of_pages(spark, d), "p", "r", _edges(spark, d))


def capped_edges(spark, d):
    space = current(spark, d, "pages", "space_id").select(F.col("id").alias("a"), "space_id")
    return graph.capped_edges_of_sources(_runs_of_pages(spark, d), "p", "r", _edges(spark, d), space, "space_id")


def graph_communities(spark, d):
    """Louvain communities of each space's page links."""
    space = current(spark, d, "pages", "space_id").select(F.col("id").alias("a"), "space_id")
    return graph.communities(_edges(spark, d).join(space, "a").select("space_id", "a", "b", F.lit(1.0).alias("weight")), "space_id")


def degree_insights(spark, d):
    return graph.degrees(_edges(spark, d))


def two_hop_expand(spark, d):
    """Pages within two links of five pages of the smallest ids."""
    e = _edges(spark, d).withColumn("weight", F.lit(3.0))
    seeds = e.select(F.col("a").alias("node")).orderBy("node").limit(5)
    return retrieval.expand_graph(seeds, e)


# Compilation

def chunks_structural(spark, d):
    c = compilation.structural_chunks(_docs(spark, d), "doc_id", "title", "text")
    return c.select("doc_id", "stable_key", F.concat_ws(" / ", "heading_path").alias("heading_path"), "start_offset", "end_offset", "quote_hash")


def chunk_validation(spark, d):
    """Chunks of documents held against their texts: reasons for quarantine, empty if accepted."""
    docs = _docs(spark, d)
    c = compilation.structural_chunks(docs, "doc_id", "title", "text").withColumn("source_key", F.col("doc_id"))
    return compilation.validation_reasons(c, docs.select(F.col("doc_id").alias("source_key"), F.col("text").alias("body")), "stable_key").groupBy(F.concat_ws(",", "reasons").alias("reasons")).agg(F.count("*").alias("n"))


def content_hash_dedupe(spark, d):
    """The first document of each content."""
    t = _docs(spark, d).where("text is not null").select("doc_id", sha(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("text"))).alias("content_hash"))
    return t.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def stable_ids(spark, d):
    return read_table(spark, d, "nation").select("n_nationkey", stable_uuid(F.lit("nation"), F.col("n_name")).alias("id"))


def title_links(spark, d):
    """Documents that mention another document's title within their space."""
    t = read_table(spark, d, "documents").where("space_id is not null").select("doc_id", "space_id", "title", "text")
    return compilation.title_links(spread(t), "doc_id", "space_id", "title", "text")


def semantic_edges(spark, d):
    """Documents of a space that share informative terms and don't mention each other's title."""
    t = spread(read_table(spark, d, "documents").select("doc_id", "space_id", "title", "text"))
    named = compilation.title_mentions(t.where("space_id is not null"), "doc_id", "space_id", "title", "text")
    return compilation.semantic_edges(t, "doc_id", "text", "space_id", named=named)


def contribution_actions(spark, d):
    rows = current(spark, d, RUN_PAGES, "source_page_id", "run_id", "status").select(ref_key("source_page_id").alias("artifact"), F.when(F.col("status") == "succeeded", ref_key("run_id")).alias("source"), "id")
    m = compilation.merge_contributions(rows.where("artifact is not null"), "artifact", "source", "id", "id")
    return m.select("artifact", "action", F.size("sources").alias("n_sources"), F.size("refs").alias("n_refs"))


def stale_chunks(spark, d):
    """Chunks that rest on a page whose source is stale."""
    gone = current(spark, d, "knowledge_sources", "source_page_id", "stale_at").where("stale_at is not null").select(ref_key("source_page_id").alias("source_id"))
    bridge = read_table(spark, d, "knowledge_chunks").select(ref_key("knowledge_page_id").alias("source_id"), "id")
    return compilation.stale_after(gone, bridge)


def policy_hash(spark, d):
    """A digest of each page's own restrictions and who is granted them, independent of the order of rows."""
    a = current(spark, d, "page_access", "page_id").select(F.col("id").alias("a"), ref_key("page_id").alias("page_id"))
    g = acl.principals(current(spark, d, "page_permissions", "page_access_id", "user_id", "group_id", "role").withColumn("page_access_id", ref_key("page_access_id")))
    who = g.groupBy(F.col("page_access_id").alias("a")).agg(F.concat_ws(",", F.array_sort(F.collect_set(F.concat_ws("=", "principal", "role")))).alias("w"))
    part = a.join(who, "a", "left").select("page_id", F.concat_ws(";", "a", F.coalesce("w", F.lit(""))).alias("p"))
    return part.where("page_id is not null").groupBy("page_id").agg(sha(F.concat_ws("|", F.array_sort(F.collect_list("p")))).alias("policy_hash"))


def author_migration(spark, d):
    """What a migration of page authors would do to each page."""
    p = live_pages(spark, d, "creator_id", "last_updated_by_id", "is_locked")
    status = F.when(F.col("creator_id").isNull(), "failed").when(F.coalesce("is_locked", F.lit(False)), "skipped").when(F.col("creator_id").eqNullSafe(F.col("last_updated_by_id")), "unchanged").otherwise("updated")
    return p.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# Incremental

def _events(spark, d) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def debounce_bursts(spark, d):
    return incremental.debounce(_events(spark, d), ["user_id"], "ts", "2 hours")


def due_bursts(spark, d):
    e = _events(spark, d)
    bursts = incremental.debounce(e, ["user_id"], "ts", "2 hours")
    return bursts.where("eligible_at <= timestamp_ntz'2024-01-10'").groupBy("user_id").agg(F.count("*").alias("due"), F.sum("change_count").alias("changes"))


def cooldown_passed(spark, d):
    return incremental.cooldown(_events(spark, d).select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", 7 * 3600)


def history_throttle(spark, d):
    """Snapshots at most every five minutes."""
    return incremental.cooldown(_events(spark, d).select("event_id", "ts", "user_id"), ["user_id"], "ts", 300)


def type_changes(spark, d):
    return incremental.changed(_events(spark, d).select("event_id", "ts", "user_id", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")


def daily_digests(spark, d):
    g = incremental.digest(_events(spark, d).select("user_id", "ts", "event_type"), ["user_id"], "ts", "event_type", 12)
    return g.select("user_id", "opened_at", "due_at", F.concat_ws(",", "items").alias("items"), "n")


_NAMES = (
    bm25_topk, dense_topk_cosine, title_hits, hybrid_rrf, hybrid_relevant, trigram_titles, context_pack, catalog_candidates, tree_closure, breadcrumbs, pruned_descent, export_names, retention_purge, acl_access, acl_nearest, acl_readers, acl_chunks, readable_parents, restricted_subtree, share_lookup, full_coverage,
    shared_source_edges, adamic_adar, derived_edges, capped_edges, graph_communities, degree_insights, two_hop_expand, chunks_structural, chunk_validation, content_hash_dedupe, stable_ids, title_links, semantic_edges, contribution_actions, stale_chunks, policy_hash, author_migration, debounce_bursts, due_bursts, cooldown_passed, history_throttle, type_changes, daily_digests,
)
QUERIES = {f.__name__: f for f in _NAMES}

_LIVE = f"(select * from {CUR.format('pages')} where deleted_at is null)"
_VEC = "[" + ", ".join(map(str, AT)) + "]::double[64]"
_BM25 = """bm as (
  with t as (select doc_id, list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), []) as w, regexp_replace(coalesce(text, ''), '[^\\p{Han}]', '', 'g') as h from documents),
  r as (select doc_id, len(w) + length(h) + greatest(length(h) - 1, 0) as n, len(list_filter(w, lambda x: x = 'draft')) as a, len(list_filter(w, lambda x: x = 'locked')) as b, len(list_filter(w, lambda x: x = 'page')) as c from t),
  s as (select count(*) as nn, avg(n) as l, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db, count(*) filter (c > 0) as dc from r),
  x as (select doc_id, round(ln(1 + (nn - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * n / l)) + ln(1 + (nn - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * n / l)) + 2 * ln(1 + (nn - dc + 0.5) / (dc + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * n / l)), 6) as score from r, s)
  select doc_id, score, row_number() over (order by score desc, doc_id) as rank from x where score > 0 qualify rank <= 20)"""
_DENSE = f"de as (select doc_id, distance, row_number() over (order by distance, doc_id) as rank from (select vec_id as doc_id, round(1 - array_cosine_similarity(embedding::double[64], {_VEC}), 6) as distance from embeddings) qualify rank <= 20)"
_TITLE = r"ti as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from (select doc_id, case when t = 'the outline' then 1.0 when length(t) >= 2 and (contains('the outline', t) or contains(t, 'the outline')) then 0.5 end::double as score from (select doc_id, regexp_replace(lower(trim(title)), '\s+', ' ', 'g') as t from documents where title is not null)) where score is not null qualify rank <= 20)"
_RRF = f"with {_BM25}, {_DENSE}, {_TITLE}, al as (select doc_id, 'lexical' as signal, 1.0::double / (60 + rank) as s, 1 as p from bm union all select doc_id, 'semantic', 1.0::double / (60 + rank), 2 from de union all select doc_id, 'exact-title', 1.0::double / (60 + rank), 3 from ti), fu as (select doc_id, round(sum(s), 9) as score, string_agg(signal, ',' order by signal) as signals, max(p) as p from al group by 1), rr as (select doc_id, score, signals, row_number() over (order by score desc, p desc, doc_id) as rank from fu qualify rank <= 20)"
_CLO = f"with recursive node as (select c.id, p.id as parent from (select id, {KEY.format('parent_page_id')} as key from {CUR.format('pages')}) c left join (select id from {CUR.format('pages')}) p on p.id = c.key), walk(id) as (select id from node where parent is null union all select n.id from node n join walk w on n.parent = w.id), clo(page_id, ancestor_id, depth) as (select id, id, 0 from walk union all select c.page_id, n.parent, c.depth + 1 from clo c join node n on n.id = c.ancestor_id where n.parent is not null)"
_ACL = f""", need as (select c.page_id, a.id as aid, c.depth from clo c join (select id, {KEY.format('page_id')} as pid from {CUR.format('page_access')}) a on a.pid = c.ancestor_id),
perm as (select {KEY.format('page_access_id')} as aid, user_id, group_id, role from {CUR.format('page_permissions')}),
prin as (select aid, 'u:' || user_id as who, role from perm where user_id is not null union all select aid, 'g:' || group_id, role from perm where group_id is not null),
mine as (select aid, bool_or(role = 'writer') as wr from prin where who in ((select 'u:' || min(user_id) from page_permissions), (select 'g:' || min(group_id) from page_permissions)) group by 1),
per as (select n.page_id, n.depth, bool_and(m.aid is not null) as r, bool_or(coalesce(m.wr, false)) as w from need n left join mine m on m.aid = n.aid group by 1, 2),
pa as (select page_id, min(depth) = 0 as direct, max(depth) > 0 as inherited, bool_and(r) as r, arg_min(w, depth) as w from per group by 1),
acc as (select id as page_id, coalesce(direct, false) as direct, coalesce(inherited, false) as inherited, coalesce(r, true) as can_read, coalesce(r and w, true) as can_edit from walk left join pa p on p.page_id = id)"""
_EDGE = f"ed as (select id as a, key as b from (select id, {KEY.format('parent_page_id')} as key from {CUR.format('pages')}) where key is not null), und as (select distinct least(a, b) as a, greatest(a, b) as b from ed where a <> b), nb as (select a as node, b as other from und union all select b, a from und)"
_SHARED = f"sl as (select distinct {KEY.format('source_page_id')} as n, {KEY.format('run_id')} as s from {CUR.format(RUN_PAGES)}), sh as (select x.n as a, y.n as b, count(*) as shared from sl x join sl y on x.s = y.s and x.n < y.n group by 1, 2)"
_AA = "dw as (select node, 1 / ln(greatest(count(*), 2)) as w from nb group by 1), aa as (select x.other as a, y.other as b, round(sum(w), 6) as score from nb x join nb y on x.node = y.node and x.other < y.other join dw on dw.node = x.node group by 1, 2)"
_BURST = "b as (select *, sum(n) over (partition by user_id order by ts, event_id) as g from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hours then 0 else 1 end as n from events where ts is not null and user_id is not null)), bu as (select user_id, count(*) as change_count, min(ts) as first_changed_at, max(ts) as last_changed_at, max(ts) + interval 2 hours as eligible_at from b group by user_id, g)"
_COOLDOWN = """
with recursive q as (select *, row_number() over (partition by {keys} order by ts, event_id) as k from events where ts is not null and user_id is not null and event_type is not null),
f as (select {cols}, k, ts as held, true as ok from q where k = 1
      union all select {cols_q}, q.k, case when q.ts - f.held >= {gap} then q.ts else f.held end, q.ts - f.held >= {gap} from f join q on {same} and q.k = f.k + 1)
select {cols} from f where ok"""
SQL = {
    "bm25_topk": f"with {_BM25} select * from bm",
    "dense_topk_cosine": f"with {_DENSE} select * from de",
    "title_hits": f"with {_TITLE} select * from ti",
    "hybrid_rrf": _RRF + " select * from rr",
    "hybrid_relevant": _RRF + " select rr.doc_id, rr.rank from rr left join documents d on d.doc_id = rr.doc_id left join de on de.doc_id = rr.doc_id where contains(signals, 'exact-title') or contains(signals, 'lexical') or (contains(signals, 'semantic') and (distance is null or distance <= 0.45 or list_has_any(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_./:-]{2,}'), ['draft', 'page', 'locked'])))",
    "trigram_titles": "with t as (select p_partkey, list_distinct(flatten(list_transform(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) as g from part), q as (select list_distinct(flatten(list_transform(['blue', 'widget'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) as h) select p_partkey, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) as similarity from t, q where similarity > 0.15",
    "context_pack": "with w as (select space_id, doc_id, text, least(length(text), 500) as want, 3000 - coalesce(sum(least(length(text), 500)) over (partition by space_id order by doc_id rows between unbounded preceding and 1 preceding), 0) as remain from documents where space_id is not null and length(text) > 0) select space_id, doc_id, length(p) as n, md5(p) as digest from (select space_id, doc_id, substr(text, 1, least(want, remain)::int) as p from w where remain > 0)",
    "catalog_candidates": "with u as (select l_partkey as k, 'returned' as s, l_quantity as v from lineitem where l_returnflag = 'R' union all select l_partkey, 'cheap', l_discount * 100 from lineitem where l_discount >= 0.09 union all select l_partkey, 'bulk', l_quantity / 2 from lineitem where l_quantity > 45) select k, bool_or(s = 'returned') as returned, bool_or(s = 'cheap') as cheap, bool_or(s = 'bulk') as bulk, round(max(v), 4) as score from u group by k order by score desc, k limit 512",
    "tree_closure": _CLO + " select * from clo",
    "breadcrumbs": _CLO + f" select page_id, string_agg(coalesce(title, 'untitled'), ' > ' order by depth desc) as crumbs from clo join {CUR.format('pages')} p on p.id = ancestor_id group by 1",
    "pruned_descent": _CLO + f" select id as page_id from walk where id not in (select page_id from clo join {CUR.format('pages')} p on p.id = ancestor_id where is_locked)",
    "export_names": f"select id, case when k = 0 then t else t || ' (' || k || ')' end as name from (select id, t, row_number() over (partition by coalesce({KEY.format('parent_page_id')}, ''), t order by position nulls first, id) - 1 as k from (select *, coalesce(nullif(trim(title), ''), 'untitled') as t from {_LIVE}))",
    "retention_purge": _CLO + f" select distinct page_id from clo join {CUR.format('pages')} p on p.id = ancestor_id where p.deleted_at < timestamp '2026-03-01' - interval 30 days",
    "acl_access": _CLO + _ACL + " select * from acc",
    "acl_nearest": _CLO + _ACL + " select page_id, aid as page_access_id, depth from need qualify row_number() over (partition by page_id order by depth, aid) = 1",
    "acl_readers": _CLO
    + _ACL
    + """, mem as (select distinct u.user_id, g.group_id from perm u join perm g on u.aid = g.aid where u.user_id is not null and g.group_id is not null),
held as (select aid, user_id from perm where user_id is not null union select p.aid, m.user_id from perm p join mem m on m.group_id = p.group_id),
own as (select page_id, min(aid) as name from need where depth = 0 group by 1),
req as (select distinct o.name as page_access_id, n.aid from own o join need n on n.page_id = o.page_id)
select r.page_access_id, h.user_id from req r join held h on h.aid = r.aid group by 1, 2 having count(*) = (select count(*) from req x where x.page_access_id = r.page_access_id)""",
    "restricted_subtree": _CLO + _ACL + ", size as (select ancestor_id as root, count(*) as n from clo where ancestor_id in (select id from node where parent is null) group by 1 order by n desc, root limit 5) select distinct need.page_id from need join clo on clo.page_id = need.page_id join size on size.root = clo.ancestor_id",
    "share_lookup": _CLO + f" select page_id, ancestor_id as share_page_id, depth as level from clo join {CUR.format('pages')} p on p.id = ancestor_id where is_locked qualify row_number() over (partition by page_id order by depth) = 1",
    "acl_chunks": _CLO + _ACL + f" select c.id as chunk_id, bool_and(coalesce(can_read, false)) as readable from (select id, {KEY.format('knowledge_page_id')} as pid from knowledge_chunks where stale_at is null) c left join acc on acc.page_id = c.pid group by 1",
    "readable_parents": _CLO + _ACL + f" select distinct {KEY.format('parent_page_id')} as parent_id from {_LIVE} p join acc on acc.page_id = p.id where can_read and parent_id is not null",
    "full_coverage": f"with r as (select {KEY.format('run_id')} as run_id, source_page_id as s, status from {CUR.format(RUN_PAGES)}) select run_id, bool_and(coalesce(s in (select s from r where status = 'succeeded' and s is not null and run_id is not null), false)) as complete from r where run_id is not null group by 1",
    "shared_source_edges": f"with {_SHARED} select * from sh",
    "adamic_adar": f"with {_EDGE}, {_AA} select * from aa",
    "derived_edges": f"with {_EDGE}, {_AA}, {_SHARED}, j as (select coalesce(sh.a, aa.a) as a, coalesce(sh.b, aa.b) as b, coalesce(shared, 0) as shared, coalesce(score, 0) as score from sh full join aa on sh.a = aa.a and sh.b = aa.b) select a, b, round(4.0::double * shared + 1.5::double * score + 0.5, 3) as weight, case when shared > 0 and score > 0 then 'both' when shared > 0 then 'source' else 'neighbour' end as reason from j where (a, b) not in (select a, b from und)",
    "degree_insights": f"with {_EDGE} select node, count(*) as degree from (select a as node from ed union all select b from ed) group by 1",
    "two_hop_expand": f"with {_EDGE}, bo as (select a, b from ed where a <> b union select b, a from ed where a <> b), s as (select distinct a as node from ed order by 1 limit 5), h1 as (select distinct b as node from bo join s on a = s.node where b not in (select node from s)), h2 as (select distinct b as node from bo join h1 on a = h1.node where b not in (select node from s) and b not in (select node from h1)) select node, 1 as hop, 3.0::double as score from h1 union all select node, 2, 1.5 from h2",
    "content_hash_dedupe": "select 'sha256:' || sha256(coalesce(title, '') || chr(10) || text) as content_hash, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1",
    "stable_ids": "select n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(h, 17, 1))::int & 3), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from (select n_nationkey, sha256('nation:' || n_name) as h from nation)",
    "contribution_actions": f"select artifact, case n when 0 then 'remove' when 1 then 'keep' else 'merge' end as action, n::int as n_sources, m::int as n_refs from (select {KEY.format('source_page_id')} as artifact, count(distinct case when status = 'succeeded' then {KEY.format('run_id')} end) as n, count(distinct id) as m from {CUR.format(RUN_PAGES)} group by 1) where artifact is not null",
    "stale_chunks": f"select distinct id from knowledge_chunks where {KEY.format('knowledge_page_id')} in (select {KEY.format('source_page_id')} from {CUR.format('knowledge_sources')} where stale_at is not null and {KEY.format('source_page_id')} is not null)",
    "policy_hash": f"with p as (select {KEY.format('page_access_id')} as aid, user_id, group_id, role from {CUR.format('page_permissions')}), w as (select aid, string_agg(distinct x, ',' order by x) as w from (select aid, 'u:' || user_id || '=' || role as x from p where user_id is not null union all select aid, 'g:' || group_id || '=' || role from p where group_id is not null) group by 1), q as (select {KEY.format('page_id')} as page_id, a.id || ';' || coalesce(w, '') as part from {CUR.format('page_access')} a left join w on w.aid = a.id) select page_id, 'sha256:' || sha256(string_agg(part, '|' order by part)) as policy_hash from q where page_id is not null group by 1",
    "author_migration": f"select case when creator_id is null then 'failed' when coalesce(is_locked, false) then 'skipped' when creator_id is not distinct from last_updated_by_id then 'unchanged' else 'updated' end as status, count(*) as n from {_LIVE} group by 1",
    "debounce_bursts": f"with {_BURST} select * from bu",
    "due_bursts": f"with {_BURST} select user_id, count(*) as due, sum(change_count)::bigint as changes from bu where eligible_at <= '2024-01-10' group by 1",
    "type_changes": "select event_id, ts, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as bef, row_number() over (partition by user_id order by ts, event_id) as rn from events) where case when rn = 1 then coalesce(event_type, '') <> '' else event_type is distinct from bef end",
    "cooldown_passed": _COOLDOWN.format(keys="user_id, event_type", gap="interval 7 hours", cols="event_id, ts, user_id, event_type", cols_q="q.event_id, q.ts, q.user_id, q.event_type", same="q.user_id = f.user_id and q.event_type = f.event_type"),
    "history_throttle": _COOLDOWN.format(keys="user_id", gap="interval 5 minutes", cols="event_id, ts, user_id", cols_q="q.event_id, q.ts, q.user_id", same="q.user_id = f.user_id"),
    "title_links": r"""
with t as materialized (select doc_id, space_id, lower(trim(title)) as t from documents where space_id is not null and length(trim(title)) >= 3),
d as materialized (select doc_id, space_id, lower(text) as x from documents where text is not null),
c as materialized (select d.doc_id as f, t.doc_id as g, x, t from d join t on t.space_id = d.space_id and t.doc_id <> d.doc_id where contains(x, t))
select distinct f as "from", g as "to" from c
where not regexp_full_match(t, '[\x00-\x7f]*') or regexp_matches(x, '(^|[^\p{L}\p{N}_])' || regexp_escape(t) || '($|[^\p{L}\p{N}_])')""",
}
