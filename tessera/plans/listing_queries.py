"""Listings, first rows, differences, pages, quotas and counts over the wiki's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import contains_unaccented, error_class, error_code, last_part
from tessera.operators.relational import blend, first_rows, keyset_page, offset_page, quota_selection, set_diff, three_way_diff, winning_rows
from tessera.sources.tables import current_rows, read_table, ref_key

CUR = "(select distinct on (id) * from {0} order by id, updated_at desc)"
KEY = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
RUN_PAGES = "knowledge_space_compile_run_pages"


def current(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Current rows of a table, of the given columns; only these are read and shuffled."""
    want = dict.fromkeys([*cols, "id", "updated_at"])
    return current_rows(read_table(spark, sf_dir, name).select(*want)).select(*dict.fromkeys(["id", *cols]))


def live_pages(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return current(spark, sf_dir, "pages", "deleted_at", *cols).where("deleted_at is null").drop("deleted_at")


def listing_unaccented(spark, d):
    """Pages whose title holds a string, whatever its case and accents."""
    return live_pages(spark, d, "title", "space_id").where(contains_unaccented("title", "Élar") | contains_unaccented("title", "AGE"))


def documents_keyset(spark, d):
    """A page of documents by time, newest first, behind a cursor; a date as upper bound means its whole day."""
    docs = read_table(spark, d, "documents").select("doc_id", "title", "created_at")
    span = docs.where("created_at >= timestamp_ntz'2025-03-01' and created_at < timestamp_ntz'2025-06-30' + interval 1 day")
    cursor = [span.sparkSession.sql("select timestamp_ntz'2025-06-10 12:00:00' as t").first()[0], 0]
    return keyset_page(span, [("created_at", True), ("doc_id", False)], 20, after=cursor)


def latest_then_filter(spark, d):
    """The latest row of each compiled page, and of these the failed: a page that later succeeded isn't listed."""
    rows = current(spark, d, RUN_PAGES, "source_page_id", "status", "merge_status", "error_code", "updated_at")
    best = first_rows(rows.where("source_page_id is not null"), ["source_page_id"], [F.col("updated_at").desc_nulls_last(), F.col("id").desc()])
    return best.where("status = 'failed' or merge_status = 'failed'").select("source_page_id", "id", "status", error_code("error_code").alias("error_code"))


def winning_run_rows(spark, d):
    """All rows of the run that finished last for each page."""
    rows = current(spark, d, RUN_PAGES, "source_page_id", "run_id", "finished_at", "updated_at")
    rows = rows.withColumn("run_id", ref_key("run_id")).where("source_page_id is not null and run_id is not null")
    return winning_rows(rows, ["source_page_id"], "run_id", [F.col("finished_at").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("id").desc()]).select("source_page_id", "run_id", "id")


def keep_newest(spark, d):
    """The three newest permissions of each user; the others would be trimmed."""
    rows = current(spark, d, "page_permissions", "user_id", "created_at").where("user_id is not null")
    return first_rows(rows, ["user_id"], [F.col("created_at").desc_nulls_last(), F.col("id").desc()], 3).select("user_id", "id")


def orders_offset_page(spark, d):
    o = read_table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return offset_page(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 40, 20)


def backlink_set_diff(spark, d):
    """References to insert and to delete between two states of who ordered with which priority."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    return set_diff(o.where("y = 1995"), o.where("y = 1996"), ["o_custkey", "o_orderpriority"])


def source_versions_diff(spark, d):
    """Inserts, deletes and updates between the pages as first and as last written."""
    p = read_table(spark, d, "pages").select("id", "title", "parent_page_id", "deleted_at", "updated_at")
    first = first_rows(p, ["id"], [F.col("updated_at").asc_nulls_first(), F.col("title"), F.col("parent_page_id"), F.col("deleted_at")]).where("deleted_at is null")
    last = current_rows(p).where("deleted_at is null")
    return three_way_diff(first, last, ["id"], ["title", "parent_page_id"])


def trash_roots(spark, d):
    """Deleted pages whose parent isn't deleted too."""
    p = current(spark, d, "pages", "parent_page_id", "space_id", "deleted_at").where("deleted_at is not null")
    gone = p.select(F.lower("id").alias("parent"))
    return p.withColumn("parent", ref_key("parent_page_id")).join(gone, "parent", "left_anti").select("id", "space_id")


def removed_sources(spark, d):
    """Source pages known to sources or attachments that aren't live pages."""
    s = current(spark, d, "knowledge_sources", "source_page_id").select(ref_key("source_page_id").alias("page_id"))
    a = current(spark, d, "attachments", "page_id").select(ref_key("page_id").alias("page_id"))
    return s.union(a).where("page_id is not null").distinct().join(live_pages(spark, d).select(F.lower("id").alias("page_id")), "page_id", "left_anti")


def principals_per_access(spark, d):
    """Distinct users and groups of each restriction, and its highest role."""
    p = current(spark, d, "page_permissions", "page_access_id", "user_id", "group_id", "role").withColumn("a", ref_key("page_access_id")).where("a is not null")
    both = p.select("a", F.concat(F.lit("u:"), "user_id").alias("who"), "role").union(p.select("a", F.concat(F.lit("g:"), "group_id").alias("who"), "role"))
    rank = F.when(F.col("role") == "writer", 2).when(F.col("role") == "reader", 1).otherwise(0)
    return both.groupBy(F.col("a").alias("page_access_id")).agg(F.count_distinct("who").alias("members"), F.max(F.struct(rank.alias("r"), "role"))["role"].alias("highest_role"))


def run_diagnostics(spark, d):
    """Counts with conditions in one pass; the last hour ends at a given time, never at the wall clock's."""
    now = F.lit("2026-06-01").cast("timestamp_ntz")
    r = current(spark, d, "knowledge_space_compile_runs", "status", "phase", "queued_at", "finished_at")
    lately = (F.col("finished_at") >= now - F.expr("interval 720 hours")) & (F.col("finished_at") < now)
    return r.agg(
        F.count_if(F.col("status").isin("queued", "compiling", "aggregate_pending", "aggregating")).alias("active"), F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status").isin("succeeded", "partial") & lately).alias("recent_completed"),
        F.count_if((F.col("status") == "failed") & lately).alias("recent_failed"), F.min(F.when(F.col("status") == "queued", F.col("queued_at"))).alias("oldest_queued"), F.count_distinct("phase").alias("phases"), F.count("*").alias("runs"),
    )


def run_status_counts(spark, d):
    return current(spark, d, "knowledge_space_compile_runs", "status", "phase").groupBy("status", "phase").agg(F.count("*").alias("n"))


def failure_classes(spark, d):
    """Failed pages of runs by the first class that fits their error code; without a code they have none."""
    r = current(spark, d, RUN_PAGES, "status", "merge_status", "error_code").where("status = 'failed' or merge_status = 'failed'")
    return r.groupBy(error_class("error_code").alias("class")).agg(F.count("*").alias("n"))


def image_rollup(spark, d):
    """Image counts of each run with nulls as nothing, and the status they lead to."""
    r = current(spark, d, RUN_PAGES, "run_id", "expected_image_count", "succeeded_image_count", "failed_image_count", "skipped_image_count").withColumn("run_id", ref_key("run_id")).where("run_id is not null")
    total = lambda c: F.coalesce(F.sum(f"{c}_image_count"), F.lit(0))
    g = r.groupBy("run_id").agg(*[total(c).alias(c) for c in ("expected", "succeeded", "failed", "skipped")])
    done = F.col("succeeded") + F.col("failed") + F.col("skipped")
    return g.withColumn("state", F.when(F.col("expected") == 0, "none").when(done < F.col("expected"), "running").when(F.col("failed") > 0, "partial").otherwise("succeeded"))


def spaces_keyset(spark, d):
    """A keyset page over a computed column: spaces by number of pages, then id."""
    g = live_pages(spark, d, "space_id").groupBy("space_id").agg(F.count("*").alias("n_pages"))
    return keyset_page(g, [("n_pages", True), ("space_id", False)], 10, after=[30, ""])


def titles_keyset(spark, d):
    """The page before a cursor in the order of titles, pages without one last: backwards, so nearest to the cursor first."""
    return keyset_page(live_pages(spark, d, "title"), [("title", False), ("id", False)], 25, before=[None, "8"])


def page_cards(spark, d):
    """Pages with their attachments' names, their parent's title and whether they have children."""
    p = live_pages(spark, d, "title", "slug_id", "parent_page_id").withColumn("parent", ref_key("parent_page_id"))
    names = current(spark, d, "attachments", "page_id", "file_name", "deleted_at").where("deleted_at is null").groupBy(ref_key("page_id").alias("id")).agg(F.array_sort(F.collect_list("file_name")).alias("f"))
    kids = p.where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("k", F.lit(True))
    up = p.select(F.col("id").alias("parent"), F.col("title").alias("parent_title"))
    card = p.join(names, "id", "left").join(kids, "id", "left").join(up, "parent", "left")
    name = F.coalesce(F.nullif("title", F.lit("")), "slug_id", "id")
    return card.select("id", name.alias("name"), "parent_title", F.coalesce(F.concat_ws("|", "f"), F.lit("")).alias("files"), F.coalesce("k", F.lit(False)).alias("has_children"), last_part("slug_id").alias("slug"))


def chat_tail(spark, d):
    """The last five messages of each chat, in the order of time."""
    m = current(spark, d, "ai_chat_messages", "chat_id", "created_at", "deleted_at", "role").where("deleted_at is null").withColumn("chat_id", ref_key("chat_id"))
    tail = first_rows(m.where("chat_id is not null"), ["chat_id"], [F.col("created_at").desc_nulls_last(), F.col("id").desc()], 5)
    return tail.select("chat_id", "id", F.row_number().over(Window.partitionBy("chat_id").orderBy(F.col("created_at").asc_nulls_first(), "id")).alias("position"))


def chunk_quota(spark, d):
    """Ten summaries and ten texts first, then the best of the rest but summaries, forty in all."""
    c = read_table(spark, d, "knowledge_chunks").where("stale_at is null").select("id", "chunk_role", "start_offset").dropDuplicates(["id", "chunk_role", "start_offset"])
    return quota_selection(c, "chunk_role", [F.col("start_offset").desc_nulls_last(), F.col("id")], {"summary": 10, "text": 10}, 40, ["summary"]).select("id", "chunk_role", "picked")


def blended_results(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("rank"), "o_orderpriority")
    one = o.groupBy("k").agg(F.min("rank").alias("r"), F.min("o_orderpriority").alias("p")).withColumn("r", F.col("r") * 1_000_000 + F.col("k"))
    return blend(one.where("p = '1-URGENT'").withColumnRenamed("r", "rank"), one.where("p in ('1-URGENT', '5-LOW')").withColumnRenamed("r", "rank"), "k", "rank", 20)


def audit_rates(spark, d):
    """Rates over the last thousand events: numbers missing from the JSON count as nothing."""
    e = read_table(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1000)
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return e.agg(F.round(F.avg((k == 0).cast("double")), 6).alias("zero_rate"), F.round(F.avg(k), 6).alias("avg_k"), F.round(F.avg(F.coalesce("value", F.lit(0.0))), 6).alias("avg_value"), F.count("*").alias("n"))


def quality_report(spark, d):
    """Health of each space: sources, chunks and restrictions are aggregated by page before they are joined.

    A source counts whatever its state. A page's access policy is stale if a restriction of it was changed
    after the page's sources were last written.
    """
    p = live_pages(spark, d, "space_id", "text_content").select(F.col("id").alias("page_id"), "space_id", (F.coalesce(F.length("text_content"), F.lit(0)) > 0).alias("has_text"))
    s = current(spark, d, "knowledge_sources", "source_page_id", "stale_at", "updated_at").groupBy(ref_key("source_page_id").alias("page_id"))
    s = s.agg(F.count("*").alias("n"), F.count("stale_at").alias("stale"), F.min("stale_at").alias("oldest"), F.max("updated_at").alias("written"))
    c = read_table(spark, d, "knowledge_chunks").select("id", ref_key("knowledge_page_id").alias("page_id"), F.col("embedding").isNull().alias("bare"))
    c = c.groupBy("page_id").agg(F.count_distinct("id").alias("chunks"), F.bool_or("bare").alias("bare"))
    a = current(spark, d, "page_access", "page_id", "updated_at").groupBy(ref_key("page_id").alias("page_id")).agg(F.max("updated_at").alias("changed"))
    j = p.join(s, "page_id", "left").join(c, "page_id", "left").join(a, "page_id", "left")
    no = lambda x: F.coalesce(F.col(x), F.lit(0)) == 0
    j = j.select(
        "space_id", "oldest", (~no("chunks")).alias("has_chunks"), (~no("stale")).alias("old_source"), F.coalesce(F.col("changed") > F.col("written"), F.lit(False)).alias("old_policy"),
        (F.col("has_text") & no("n")).alias("no_source"), (F.col("has_text") & no("chunks")).alias("no_chunks"), F.coalesce("bare", F.lit(False)).alias("no_embedding"),
    )
    old = F.col("old_source") | F.col("old_policy")
    minus = [F.when(bad, n).otherwise(0) for bad, n in ((old, 30), (F.col("no_source"), 35), (F.col("no_chunks"), 35), (F.col("no_embedding"), 40))]
    g = j.withColumn("score", F.greatest(F.lit(0), 100 - sum(minus))).groupBy("space_id").agg(
        F.count("*").alias("pages"), F.count_if("has_chunks").alias("compiled"), F.count_if(old).alias("stale"), *[F.count_if(c).alias(c) for c in ("old_source", "old_policy", "no_source", "no_chunks", "no_embedding")],
        F.min("oldest").alias("oldest_stale_at"), F.sum("score").alias("score_sum"),
    )
    return g.withColumn("health", F.floor(F.col("score_sum") / F.col("pages") + 0.5).cast("long"))


def reuse_decision(spark, d):
    """Whether the last successful compilation of a page still holds: its source is live and no younger than it."""
    rows = current(spark, d, RUN_PAGES, "source_page_id", "status", "finished_at", "expected_image_count").where("status = 'succeeded'")
    last = first_rows(rows.withColumn("page_id", ref_key("source_page_id")).where("page_id is not null"), ["page_id"], [F.col("finished_at").desc_nulls_last(), F.col("id").desc()])
    src = current(spark, d, "knowledge_sources", "source_page_id", "updated_at", "stale_at", "deleted_at").where("stale_at is null and deleted_at is null").groupBy(ref_key("source_page_id").alias("page_id")).agg(F.max("updated_at").alias("written"))
    ok = (F.col("written") <= F.col("finished_at")) & (F.coalesce("expected_image_count", F.lit(0)) <= 50)
    return last.join(src, "page_id", "left").select("page_id", F.coalesce(ok, F.lit(False)).alias("reuse"))


_NAMES = (listing_unaccented, documents_keyset, latest_then_filter, winning_run_rows, keep_newest, orders_offset_page, backlink_set_diff, source_versions_diff, trash_roots, removed_sources, principals_per_access, run_diagnostics, run_status_counts, failure_classes, image_rollup, spaces_keyset, titles_keyset, page_cards, chat_tail, chunk_quota, blended_results, audit_rates, quality_report, reuse_decision)
QUERIES = {f.__name__: f for f in _NAMES}

_RP = CUR.format(RUN_PAGES)
_LIVE = f"(select * from {CUR.format('pages')} where deleted_at is null)"
SQL = {
    "listing_unaccented": f"select id, title, space_id from {_LIVE} where contains(strip_accents(lower(title)), 'elar') or contains(strip_accents(lower(title)), 'age')",
    "documents_keyset": "select doc_id, title, created_at from documents where created_at >= '2025-03-01' and created_at < timestamp '2025-06-30' + interval 1 day and (created_at < '2025-06-10 12:00:00' or (created_at = '2025-06-10 12:00:00' and doc_id > 0)) order by created_at desc, doc_id limit 21",
    "latest_then_filter": f"select source_page_id, id, status, substr(regexp_replace(lower(error_code), '[^a-z0-9_-]', '_', 'g'), 1, 80) as error_code from (select *, row_number() over (partition by source_page_id order by updated_at desc nulls last, id desc) as rn from {_RP} where source_page_id is not null) where rn = 1 and (status = 'failed' or merge_status = 'failed')",
    "winning_run_rows": f"with r as (select *, {KEY.format('run_id')} as run from {_RP} where source_page_id is not null), w as (select source_page_id as s, run as best from r where run is not null qualify row_number() over (partition by source_page_id order by finished_at desc nulls last, updated_at desc nulls last, id desc) = 1) select source_page_id, run as run_id, id from r join w on s = source_page_id and run = best",
    "keep_newest": f"select user_id, id from {CUR.format('page_permissions')} where user_id is not null qualify row_number() over (partition by user_id order by created_at desc nulls last, id desc) <= 3",
    "orders_offset_page": "select o_orderkey, o_totalprice, count(*) over () as total from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 20 offset 40",
    "backlink_set_diff": "with o as (select distinct o_custkey, o_orderpriority from orders where year(o_orderdate) = 1995), n as (select distinct o_custkey, o_orderpriority from orders where year(o_orderdate) = 1996) select *, 'delete' as action from (select * from o except select * from n) union all select *, 'insert' from (select * from n except select * from o)",
    "source_versions_diff": f"with f as (select * from pages qualify row_number() over (partition by id order by updated_at asc nulls first, title nulls first, parent_page_id nulls first, deleted_at nulls first) = 1), o as (select id, title, parent_page_id from f where deleted_at is null), n as (select id, title, parent_page_id from {_LIVE}) select coalesce(o.id, n.id) as id, case when o.id is null then 'insert' when n.id is null then 'delete' else 'update' end as action from o full join n on o.id = n.id where o.id is null or n.id is null or o.title is distinct from n.title or o.parent_page_id is distinct from n.parent_page_id",
    "trash_roots": f"with g as (select *, {KEY.format('parent_page_id')} as parent from {CUR.format('pages')} where deleted_at is not null) select id, space_id from g where parent is null or parent not in (select id from g)",
    "removed_sources": f"select page_id from (select {KEY.format('source_page_id')} as page_id from {CUR.format('knowledge_sources')} union select {KEY.format('page_id')} from {CUR.format('attachments')}) where page_id is not null and page_id not in (select id from {_LIVE})",
    "principals_per_access": f"with p as (select {KEY.format('page_access_id')} as a, user_id, group_id, role from {CUR.format('page_permissions')}), b as (select a, 'u:' || user_id as who, role from p union all select a, 'g:' || group_id, role from p) select a as page_access_id, count(distinct who) as members, arg_max(role, case role when 'writer' then 2 when 'reader' then 1 else 0 end) as highest_role from b where a is not null group by a",
    "run_diagnostics": f"select count(*) filter (status in ('queued', 'compiling', 'aggregate_pending', 'aggregating')) as active, count(*) filter (status = 'queued') as queued, count(*) filter (status in ('succeeded', 'partial') and finished_at >= timestamp '2026-06-01' - interval 720 hours and finished_at < '2026-06-01') as recent_completed, count(*) filter (status = 'failed' and finished_at >= timestamp '2026-06-01' - interval 720 hours and finished_at < '2026-06-01') as recent_failed, min(queued_at) filter (status = 'queued') as oldest_queued, count(distinct phase) as phases, count(*) as runs from {CUR.format('knowledge_space_compile_runs')}",
    "run_status_counts": f"select status, phase, count(*) as n from {CUR.format('knowledge_space_compile_runs')} group by all",
    "failure_classes": f"""
select case when e is null or e = '' then null when e = 'page_timeout' then 'budget_timeout'
            when contains(e, 'provider') or contains(e, 'llm') or e in ('rate_limited', 'invalid_output') then 'provider'
            when regexp_matches(e, 'publication|import|merge') then 'publication' when regexp_matches(e, 'storage|database|embedding|job') then 'infrastructure' else 'other' end as class,
       count(*) as n
from (select lower(error_code) as e from {_RP} where status = 'failed' or merge_status = 'failed') group by 1""",
    "image_rollup": f"select *, case when expected = 0 then 'none' when succeeded + failed + skipped < expected then 'running' when failed > 0 then 'partial' else 'succeeded' end as state from (select {KEY.format('run_id')} as run_id, coalesce(sum(expected_image_count), 0)::bigint as expected, coalesce(sum(succeeded_image_count), 0)::bigint as succeeded, coalesce(sum(failed_image_count), 0)::bigint as failed, coalesce(sum(skipped_image_count), 0)::bigint as skipped from {_RP} group by 1) where run_id is not null",
    "spaces_keyset": f"select * from (select space_id, count(*) as n_pages from {_LIVE} group by 1) where n_pages < 30 or (n_pages = 30 and space_id > '') order by n_pages desc, space_id limit 11",
    "titles_keyset": f"select id, title from {_LIVE} where title is not null or id < '8' order by title desc nulls first, id desc limit 26",
    "page_cards": f"with p as (select *, {KEY.format('parent_page_id')} as parent from {_LIVE}), f as (select {KEY.format('page_id')} as pid, string_agg(file_name, '|' order by file_name) as files from {CUR.format('attachments')} where deleted_at is null group by 1) select p.id, coalesce(nullif(p.title, ''), p.slug_id, p.id) as name, u.title as parent_title, coalesce(files, '') as files, p.id in (select parent from p where parent is not null) as has_children, list_last(string_split(p.slug_id, '-')) as slug from p left join f on pid = p.id left join p u on u.id = p.parent",
    "chat_tail": f"with t as (select {KEY.format('chat_id')} as chat_id, id, created_at from {CUR.format('ai_chat_messages')} where deleted_at is null), k as (select * from t where chat_id is not null qualify row_number() over (partition by chat_id order by created_at desc nulls last, id desc) <= 5) select chat_id, id, row_number() over (partition by chat_id order by created_at, id) as position from k",
    "chunk_quota": "with c as (select distinct id, chunk_role, start_offset from knowledge_chunks where stale_at is null), k as (select *, row_number() over (partition by chunk_role order by start_offset desc nulls last, id) as k from c), p as (select *, case when k <= case when chunk_role in ('summary', 'text') then 10 else 0 end then 0 when chunk_role <> 'summary' then 1 end as picked from k) select id, chunk_role, picked from p where picked is not null order by picked, start_offset desc nulls last, id limit 40",
    "blended_results": "with o as (select o_orderkey as k, min(o_custkey) * 1000000 + o_orderkey as r, min(o_orderpriority) as p from orders group by o_orderkey), d as (select k, r from o where p = '1-URGENT' order by r limit 20), g as (select k, r from o where p in ('1-URGENT', '5-LOW') and k not in (select k from d) order by r limit 20), s as (select least(count(*), 5, 19) as share from g), a as (select k, 'direct' as origin, row_number() over (order by r) as own from d union all select k, 'graph', row_number() over (order by r) from g), b as (select a.*, case when origin = 'direct' then own > 20 - share else own > share end as late from a, s), t as (select * from b order by late, origin, own limit 20) select k, origin, row_number() over (order by late, origin, own) as position from t",
    "audit_rates": "select round(avg((k = 0)::int::double), 6) as zero_rate, round(avg(k), 6) as avg_k, round(avg(coalesce(value, 0)), 6) as avg_value, count(*) as n from (select value, coalesce((props::json->>'$.k')::double, 0) as k from events order by ts desc, event_id desc limit 1000)",
    "quality_report": f"""
with p as (select id as page_id, space_id, coalesce(length(text_content), 0) > 0 as has_text from {_LIVE}),
s as (select {KEY.format('source_page_id')} as page_id, count(*) as n, count(stale_at) as stale, min(stale_at) as oldest, max(updated_at) as written from {CUR.format('knowledge_sources')} group by 1),
c as (select {KEY.format('knowledge_page_id')} as page_id, count(distinct id) as chunks, count(*) filter (embedding is null) as bare from knowledge_chunks group by 1),
a as (select {KEY.format('page_id')} as page_id, max(updated_at) as changed from {CUR.format('page_access')} group by 1),
h as (select p.*, coalesce(n, 0) = 0 as bare_source, coalesce(stale, 0) > 0 as old_source, coalesce(changed > written, false) as old_policy, oldest, coalesce(chunks, 0) as chunks, coalesce(bare, 0) > 0 as bare
      from p left join s using (page_id) left join c using (page_id) left join a using (page_id)),
g as (select space_id, count(*) as pages, count(*) filter (chunks > 0) as compiled, count(*) filter (old_source or old_policy) as stale, count(*) filter (old_source) as old_source, count(*) filter (old_policy) as old_policy,
  count(*) filter (has_text and bare_source) as no_source, count(*) filter (has_text and chunks = 0) as no_chunks, count(*) filter (bare) as no_embedding, min(oldest) as oldest_stale_at,
  sum(greatest(0, 100 - case when old_source or old_policy then 30 else 0 end - case when has_text and bare_source then 35 else 0 end - case when has_text and chunks = 0 then 35 else 0 end - case when bare then 40 else 0 end))::bigint as score_sum
  from h group by 1)
select *, floor(score_sum / pages + 0.5)::bigint as health from g""",
    "reuse_decision": f"with l as (select *, {KEY.format('source_page_id')} as page_id from {_RP} where status = 'succeeded'), b as (select * from l where page_id is not null qualify row_number() over (partition by page_id order by finished_at desc nulls last, id desc) = 1), s as (select {KEY.format('source_page_id')} as pid, max(updated_at) as written from {CUR.format('knowledge_sources')} where stale_at is null and deleted_at is null group by 1) select page_id, coalesce(written <= finished_at and coalesce(expected_image_count, 0) <= 50, false) as reuse from b left join s on pid = page_id",
}
