"""Search, citations, lineage, runs and plans of changes over the wiki's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import evidence_score, headings, match_key
from tessera.operators import compilation, graph, runs, search
from tessera.operators.relational import first_rows
from tessera.plans.knowledge_queries import _CLO, _edges, _marked, graph_communities, tree_of
from tessera.plans.listing_queries import CUR, KEY, RUN_PAGES, current, live_pages
from tessera.session import Workspace
from tessera.sources.tables import read_table, ref_key

WEB = '"the outline" draft or policy -locked import'
TERMS = ["draft", "policy", "import"]


def web_search(spark, d):
    """Documents that a search expression with a phrase, an alternative and an exclusion finds."""
    t = read_table(spark, d, "documents").where(search.web_matches("text", WEB))
    return t.select("doc_id", F.md5(search.snippet("text", TERMS)).alias("snippet"))


def prefix_search(spark, d):
    """Pages whose title and text have words that begin with each of the query's."""
    p = live_pages(spark, d, "title", "text_content")
    return p.where(search.prefix_matches(F.concat_ws(" ", "title", "text_content"), "Comp pag")).select("id")


def labelled_documents(spark, d):
    """Documents with one of some labels, whatever the case and blanks of either."""
    wanted = spark.createDataFrame([(" Wiki_Page",), ("faq ",)], "label string").select(F.lower(F.trim("label")).alias("label"))
    return read_table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("label")).join(F.broadcast(wanted), "label", "left_semi")  # two rows


def scoped_documents(spark, d):
    """Documents of no space, and those of the five spaces with most documents."""
    docs = read_table(spark, d, "documents").select("doc_id", "space_id")
    top = docs.where("space_id is not null").groupBy("space_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "space_id").limit(5)
    return docs.where("space_id is null").unionByName(docs.join(F.broadcast(top.select("space_id")), "space_id", "left_semi"))  # five rows


def suggestions(spark, d):
    """Parts, suppliers and customers whose name holds a string: the five first of each in one result."""
    arm = lambda t, k, n: read_table(spark, d, t).where(F.contains(F.lower(n), F.lit("er#00000000"))).select(F.lit(t).alias("kind"), F.col(k).cast("long").alias("key"), F.col(n).alias("name")).orderBy("name", "key").limit(5)
    return arm("supplier", "s_suppkey", "s_name").unionByName(arm("customer", "c_custkey", "c_name")).unionByName(read_table(spark, d, "part").where(F.col("p_name").ilike("%blue%")).select(F.lit("part").alias("kind"), F.col("p_partkey").cast("long").alias("key"), F.col("p_name").alias("name")).orderBy("name", "key").limit(5))


def signal_topk(spark, d):
    """For each nation the three best customers and the three best suppliers, each by its own signal."""
    c = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("signal"), F.col("c_custkey").cast("long").alias("key"), F.col("c_acctbal").alias("score"))
    s = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("signal"), F.col("s_suppkey").cast("long").alias("key"), F.col("s_acctbal").alias("score"))
    return first_rows(c.unionByName(s), ["nation", "signal"], [F.col("score").desc(), F.col("key")], 3)


def ready_rows(spark, d):
    """One row for each page of all runs: a succeeded one if there is any, then the latest."""
    r = current(spark, d, RUN_PAGES, "source_page_id", "status", "updated_at").withColumn("page_id", ref_key("source_page_id")).where("page_id is not null")
    return first_rows(r, ["page_id"], [(F.col("status") == "succeeded").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("id").desc()]).select("page_id", "id", "status")


def evidence_channels(spark, d):
    """The channel by which each page has evidence: a live source before an attachment before a chunk."""
    s = current(spark, d, "knowledge_sources", "source_page_id", "stale_at", "deleted_at").where("stale_at is null and deleted_at is null").select(ref_key("source_page_id").alias("page_id"), F.lit("source").alias("channel"), "id")
    a = current(spark, d, "attachments", "page_id", "deleted_at").where("deleted_at is null").select(ref_key("page_id").alias("page_id"), F.lit("attachment").alias("channel"), "id")
    c = read_table(spark, d, "knowledge_chunks").where("stale_at is null").select(ref_key("knowledge_page_id").alias("page_id"), F.lit("chunk").alias("channel"), "id")
    rank = F.when(F.col("channel") == "source", 1).when(F.col("channel") == "attachment", 2).otherwise(3)
    return first_rows(s.unionByName(a).unionByName(c).where("page_id is not null"), ["page_id"], [rank, F.col("id")])


def citations(spark, d):
    """Windows of pages to be cited: text as its hash says, at most two of a page, by how many of the query's terms they hold."""
    c = read_table(spark, d, "knowledge_chunks").where("stale_at is null and text is not null").select("id", ref_key("knowledge_page_id").alias("page_id"), "text", "content_hash", "start_offset").where("page_id is not null")
    sound = c.where(F.col("content_hash") == F.concat(F.lit("sha256:"), F.sha2("text", 256))).dropDuplicates(["id", "page_id", "text"])
    terms = F.array(*map(F.lit, TERMS))
    return search.cited_windows(sound, "page_id", ["id"], evidence_score(terms, F.lower("text"))).select("page_id", "id", "score")


def lineage_stale(spark, d):
    """Chunks that rest on a page whose source is stale or gone, by any of four bridges: the page itself, its parent's
    page, a deleted attachment of it, or the same content in another chunk of such a page."""
    gone = current(spark, d, "knowledge_sources", "source_page_id", "stale_at", "deleted_at").where("stale_at is not null or deleted_at is not null").select(ref_key("source_page_id").alias("source_id")).where("source_id is not null").distinct()
    c = read_table(spark, d, "knowledge_chunks").select("id", ref_key("knowledge_page_id").alias("page_id"), "content_hash").where("page_id is not null")
    parents = current(spark, d, "pages", "parent_page_id").select(F.col("id").alias("page_id"), ref_key("parent_page_id").alias("source_id"))
    lost = current(spark, d, "attachments", "page_id", "deleted_at").where("deleted_at is not null").select(ref_key("page_id").alias("page_id")).distinct()
    direct = c.select(F.col("page_id").alias("source_id"), "id")
    hit = c.join(gone, F.col("page_id") == F.col("source_id"), "left_semi").where("content_hash is not null").select("content_hash").distinct()
    same = c.join(hit, "content_hash", "left_semi").select("id")
    files = c.join(lost, "page_id", "left_semi").select("id")
    return compilation.stale_after(gone, direct, c.join(parents, "page_id").select("source_id", "id")).unionByName(same).unionByName(files).distinct()


def equal_sets(spark, d):
    """Customers who ordered with the very same set of priorities in two years."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y")).where("y in (1995, 1996)")
    g = o.groupBy("o_custkey").agg(*[F.array_sort(F.collect_set(F.when(F.col("y") == y, F.col("o_orderpriority")))).alias(f"s{y}") for y in (1995, 1996)])
    return g.where("s1995 = s1996").select("o_custkey")


def page_watchers(spark, d):
    """Those who wrote a page, each once, as its watchers; nobody who edited it last is told of that."""
    p = live_pages(spark, d, "creator_id", "last_updated_by_id")
    one = p.select(F.col("id").alias("page_id"), F.explode(F.array_distinct(F.array_compact(F.array("creator_id", "last_updated_by_id")))).alias("user_id"), "last_updated_by_id")
    return one.select("page_id", "user_id", (~F.col("user_id").eqNullSafe(F.col("last_updated_by_id"))).alias("told"))


def co_contributors(spark, d):
    """Pairs of users who wrote the same pages, and how many."""
    p = live_pages(spark, d, "creator_id", "last_updated_by_id").where("creator_id != last_updated_by_id")
    return p.groupBy(F.least("creator_id", "last_updated_by_id").alias("a"), F.greatest("creator_id", "last_updated_by_id").alias("b")).agg(F.count("*").alias("pages"))


def backoff_schedule(spark, d):
    """The seconds to wait after each failed attempt of a page."""
    r = current(spark, d, RUN_PAGES, "source_page_id", "status", "finished_at").withColumn("page_id", ref_key("source_page_id")).where("page_id is not null and status = 'failed'")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("finished_at").asc_nulls_last(), "id"))
    return r.select("id", n.alias("attempt")).select("id", "attempt", runs.backoff(F.col("attempt")).alias("wait"))


def request_coalescing(spark, d):
    r = current(spark, d, "knowledge_space_compile_runs", "space_id", "queued_at", "finished_at")
    return runs.coalesced_requests(r.select("space_id", "id", F.col("queued_at").alias("asked_at"), F.col("finished_at").alias("ended_at")), "space_id", 600)


def _run_pages(spark, d):
    r = current(spark, d, RUN_PAGES, "run_id", "source_page_id", "status", "merge_status", "expected_image_count", "succeeded_image_count", "failed_image_count", "skipped_image_count", "queued_at")
    return r.withColumn("run_id", ref_key("run_id")).where("run_id is not null")


def run_barrier(spark, d):
    no = lambda c: F.coalesce(F.col(f"{c}_image_count"), F.lit(0))
    rows = _run_pages(spark, d).select("run_id", "status", "merge_status", F.col("expected_image_count").alias("expected"), (no("succeeded") + no("failed") + no("skipped")).alias("done"))
    return runs.barrier(rows, "run_id")


def interrupted_rows(spark, d):
    return runs.interrupted(_run_pages(spark, d), current(spark, d, "knowledge_space_compile_runs", "status"), "run_id")


def reserved_rows(spark, d):
    """Queued pages that may start, five of each run under way at most."""
    return runs.reserved(_run_pages(spark, d).select("id", "run_id", "status", "queued_at"), "run_id", [F.col("queued_at").asc_nulls_last(), F.col("id")], 5).select("run_id", "id", "place")


def run_plan(spark, d):
    """Pages to be added to the latest run of each space: live pages of the space that it has no row of."""
    latest = first_rows(current(spark, d, "knowledge_space_compile_runs", "space_id", "queued_at"), ["space_id"], [F.col("queued_at").desc_nulls_last(), F.col("id").desc()]).select(F.col("id").alias("run_id"), "space_id")
    have = _run_pages(spark, d).select("run_id", ref_key("source_page_id").alias("page_id")).where("page_id is not null").distinct()
    return live_pages(spark, d, "space_id").select(F.col("id").alias("page_id"), "space_id").join(latest, "space_id").join(have, ["run_id", "page_id"], "left_anti").select("run_id", "page_id")


def source_retirement(spark, d):
    """Sources whose page is no longer live in the source's space: moved, deleted or unknown."""
    s = current(spark, d, "knowledge_sources", "source_page_id", "source_space_id", "deleted_at").where("deleted_at is null").withColumn("page_id", ref_key("source_page_id")).where("page_id is not null")
    p = live_pages(spark, d, "space_id").select(F.lower("id").alias("page_id"), F.col("space_id").alias("source_space_id"))
    return s.join(p, ["page_id", "source_space_id"], "left_anti").select("id", "page_id")


def subtree_move(spark, d):
    """The plan to move the largest tree to another space: what moves, and the locked pages that stay and become roots."""
    ws = Workspace(spark)
    tree = ws.table(tree_of(spark, d), "all")
    root = tree.where("depth = 0").orderBy(F.col("n_descendants").desc(), "id").limit(1).select("root_id")
    mine = tree.join(F.broadcast(root), "root_id", "left_semi")  # one row
    held = _marked(spark, d, mine, "is_locked").select("id", F.col("direct").alias("locked"), "n_marks")
    both = mine.join(held, "id", "left")
    action = F.when(F.col("n_marks").isNull(), "moves").when(F.col("locked") & (F.col("n_marks") == 1), "becomes a root").otherwise("stays")
    return both.select(F.col("id").alias("page_id"), action.alias("action"))


def file_list_hash(spark, d):
    """A digest of each page's files in the order of their time, which counts."""
    a = current(spark, d, "attachments", "page_id", "file_name", "created_at", "deleted_at").where("deleted_at is null").select(ref_key("page_id").alias("page_id"), F.struct("created_at", "id", F.coalesce("file_name", F.lit("")).alias("f")).alias("x"))
    g = a.where("page_id is not null").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]).alias("fs"))
    return g.select("page_id", F.sha2(F.concat_ws("\x1f", "fs"), 256).alias("hash"))


def ordered_lookup(spark, d):
    """Nations by a list of keys, in the order of the list, repeated keys repeated."""
    keys = spark.range(1).select(F.posexplode(F.array(*map(F.lit, [7, 3, 3, 99, 0]))).alias("place", "key"))
    return keys.join(read_table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("key"), "n_name"), "key").select("place", "key", "n_name")


def graph_insights(spark, d):
    """Isolated pages, and pages with links to another community."""
    return graph.insights(_edges(spark, d), graph_communities(spark, d), current(spark, d, "pages").select(F.col("id").alias("node")))


def document_headings(spark, d):
    """The headings of Markdown documents, as they compare."""
    t = read_table(spark, d, "documents").select("doc_id", headings("text").alias("h")).where(F.size("h") > 0)
    return t.select("doc_id", F.concat_ws("|", F.transform("h", lambda x: match_key(x))).alias("headings"))


_NAMES = (
    web_search, prefix_search, labelled_documents, scoped_documents, suggestions, signal_topk, ready_rows, evidence_channels, citations, lineage_stale, equal_sets, page_watchers, co_contributors, backoff_schedule,
    request_coalescing, run_barrier, interrupted_rows, reserved_rows, run_plan, source_retirement, subtree_move, file_list_hash, ordered_lookup, graph_insights, document_headings,
)
QUERIES = {f.__name__: f for f in _NAMES}

_RP = CUR.format(RUN_PAGES)
_LIVE = f"(select * from {CUR.format('pages')} where deleted_at is null)"
_RUNS = CUR.format("knowledge_space_compile_runs")
_BARE = r"regexp_replace(' ' || lower(coalesce({0}, '')) || ' ', '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
_R = f"r as (select *, {KEY.format('run_id')} as run, {KEY.format('source_page_id')} as page from {_RP})"
SQL = {
    "web_search": f"""
with w as (select doc_id, {_BARE.format('text')} as b from documents), s as (select doc_id, b, string_split(trim(b), ' ') as a from w),
f as (select doc_id, b, list_filter(list_transform(range(0, (len(a) + 9) // 10), lambda i: a[i * 10 + 1 : i * 10 + 10]), lambda x: list_has_any(x, ['draft', 'policy', 'import'])) as h from s)
select doc_id, md5(array_to_string(list_transform(h[1:3], lambda x: array_to_string(x, ' ')), ' ... ')) as snippet from f
where (contains(b, ' the outline ') and contains(b, ' draft ')) or (contains(b, ' policy ') and not contains(b, ' locked ') and contains(b, ' import '))""",
    "prefix_search": f"select id from (select id, {_BARE.format("coalesce(title || ' ', '') || coalesce(text_content, '')")} as b from {_LIVE}) where contains(b, ' comp') and contains(b, ' pag')",
    "labelled_documents": "select doc_id, lower(trim(source)) as label from documents where label in ('wiki_page', 'faq')",
    "scoped_documents": "select doc_id, space_id from documents where space_id is null or space_id in (select space_id from documents where space_id is not null group by 1 order by count(*) desc, 1 limit 5)",
    "suggestions": "(select 'supplier' as kind, s_suppkey::bigint as key, s_name as name from supplier where contains(lower(s_name), 'er#00000000') order by name, key limit 5) union all (select 'customer', c_custkey, c_name from customer where contains(lower(c_name), 'er#00000000') order by 3, 2 limit 5) union all (select 'part', p_partkey, p_name from part where p_name ilike '%blue%' order by 3, 2 limit 5)",
    "signal_topk": "select * from (select c_nationkey as nation, 'customer' as signal, c_custkey::bigint as key, c_acctbal as score from customer union all select s_nationkey, 'supplier', s_suppkey, s_acctbal from supplier) qualify row_number() over (partition by nation, signal order by score desc, key) <= 3",
    "ready_rows": f"with {_R} select page as page_id, id, status from r where page is not null qualify row_number() over (partition by page order by (status = 'succeeded') desc nulls last, updated_at desc nulls last, id desc) = 1",
    "evidence_channels": f"select page_id, channel, id from (select {KEY.format('source_page_id')} as page_id, 'source' as channel, id, 1 as p from {CUR.format('knowledge_sources')} where stale_at is null and deleted_at is null union all select {KEY.format('page_id')}, 'attachment', id, 2 from {CUR.format('attachments')} where deleted_at is null union all select {KEY.format('knowledge_page_id')}, 'chunk', id, 3 from knowledge_chunks where stale_at is null) where page_id is not null qualify row_number() over (partition by page_id order by p, id) = 1",
    "citations": f"select page_id, id, score from (select distinct id, {KEY.format('knowledge_page_id')} as page_id, text, (4 * (contains(lower(text), 'draft')::int + contains(lower(text), 'policy')::int + contains(lower(text), 'import')::int))::int as score from knowledge_chunks where stale_at is null and content_hash = 'sha256:' || sha256(text)) where page_id is not null and score >= 1 qualify row_number() over (partition by page_id order by score desc, id) <= 2",
    "lineage_stale": f"""
with gone as (select distinct {KEY.format('source_page_id')} as k from {CUR.format('knowledge_sources')} where (stale_at is not null or deleted_at is not null) and k is not null),
c as (select id, {KEY.format('knowledge_page_id')} as page, content_hash from knowledge_chunks),
f as (select {KEY.format('page_id')} as k from {CUR.format('attachments')} where deleted_at is not null and k is not null)
select distinct c.id from c left join (select id as pid, {KEY.format('parent_page_id')} as parent from {CUR.format('pages')}) p on p.pid = c.page
where page is not null and (page in (select k from gone) or parent in (select k from gone) or page in (select k from f) or content_hash in (select content_hash from c where page in (select k from gone) and content_hash is not null))""",
    "equal_sets": "select o_custkey from orders where year(o_orderdate) in (1995, 1996) group by 1 having coalesce(list_sort(list(distinct o_orderpriority) filter (year(o_orderdate) = 1995)), []) = coalesce(list_sort(list(distinct o_orderpriority) filter (year(o_orderdate) = 1996)), [])",
    "page_watchers": f"select page_id, user_id, user_id is distinct from last_updated_by_id as told from (select id as page_id, creator_id as user_id, last_updated_by_id from {_LIVE} union select id, last_updated_by_id, last_updated_by_id from {_LIVE}) where user_id is not null",
    "co_contributors": f"select least(creator_id, last_updated_by_id) as a, greatest(creator_id, last_updated_by_id) as b, count(*) as pages from {_LIVE} where creator_id <> last_updated_by_id group by 1, 2",
    "backoff_schedule": f"with {_R} select id, attempt, least(1800, 30 * pow(2, attempt - 1))::int as wait from (select id, row_number() over (partition by page order by finished_at nulls last, id) as attempt from r where page is not null and status = 'failed')",
    "request_coalescing": f"""
with recursive q as (select space_id, id, queued_at as a, finished_at as e, row_number() over (partition by space_id order by queued_at, id) as k from {_RUNS} where space_id is not null and queued_at is not null),
f(space_id, id, k, outcome, into_, since, until_) as (
  select space_id, id, k, 'created', id, a, e from q where k = 1
  union all
  select q.space_id, q.id, q.k, case when f.until_ <= q.a then 'created' when q.a - f.since <= interval 600 seconds then 'coalesced' else 'rerun' end,
         case when f.until_ <= q.a then q.id else f.into_ end, case when f.until_ <= q.a then q.a else f.since end, case when f.until_ <= q.a then q.e else f.until_ end
  from f join q on q.space_id = f.space_id and q.k = f.k + 1)
select space_id, id, outcome, into_ as "into" from f""",
    "run_barrier": f"with {_R}, g as (select run as run_id, count(*) as pages, count(*) filter (status not in ('succeeded', 'failed', 'skipped', 'cancelled')) as open_pages, sum(greatest(0, coalesce(expected_image_count, 0) - coalesce(succeeded_image_count, 0) - coalesce(failed_image_count, 0) - coalesce(skipped_image_count, 0)))::bigint as open_images, count(*) filter (merge_status = 'pending') as u from r where run is not null group by 1) select run_id, pages, open_pages, open_images, case when open_pages > 0 then 'pages' when open_images > 0 then 'images' when u > 0 then 'image_merge' else 'finalizing' end as next_phase from g",
    "interrupted_rows": f"with {_R} select r.id, r.run as run_id, case u.status when 'cancelled' then 'cancelled' else 'failed' end as status from r join {_RUNS} u on u.id = r.run where r.status in ('queued', 'running') and u.status in ('succeeded', 'partial', 'failed', 'cancelled')",
    "reserved_rows": f"with {_R}, p as (select run as run_id, id, row_number() over (partition by run order by queued_at nulls last, id) as place from r where status = 'queued' and run is not null) select run_id, id, place from p where place <= 5 - (select count(*) from r where run = p.run_id and status = 'running')",
    "run_plan": f"with {_R}, l as (select id, space_id from {_RUNS} qualify row_number() over (partition by space_id order by queued_at desc nulls last, id desc) = 1) select l.id as run_id, p.id as page_id from l join {_LIVE} p on p.space_id = l.space_id where not exists (select 1 from r where r.run = l.id and r.page = p.id)",
    "source_retirement": f"select id, page_id from (select id, source_space_id, {KEY.format('source_page_id')} as page_id from {CUR.format('knowledge_sources')} where deleted_at is null) s where page_id is not null and not exists (select 1 from {_LIVE} p where p.id = page_id and p.space_id = s.source_space_id)",
    "subtree_move": _CLO + f""", big as (select ancestor_id as root, count(*) as n from clo where ancestor_id in (select id from node where parent is null) group by 1 order by n desc, root limit 1),
t as (select page_id from clo where ancestor_id in (select root from big)), m as (select page_id, count(*) as n, min(depth) = 0 as own from clo join {CUR.format('pages')} p on p.id = ancestor_id where is_locked group by 1)
select t.page_id, case when n is null then 'moves' when own and n = 1 then 'becomes a root' else 'stays' end as action from t left join m on m.page_id = t.page_id""",
    "file_list_hash": f"select page_id, sha256(string_agg(f, chr(31) order by created_at nulls first, id)) as hash from (select {KEY.format('page_id')} as page_id, coalesce(file_name, '') as f, created_at, id from {CUR.format('attachments')} where deleted_at is null) where page_id is not null group by 1",
    "ordered_lookup": "select place::int as place, key::int as key, n_name from (select unnest([0, 1, 2, 3, 4]) as place, unnest([7, 3, 3, 99, 0]) as key) join nation on n_nationkey = key",
    "document_headings": r"select doc_id, array_to_string(list_transform(h[1:32], lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')), '|') as headings from (select doc_id, regexp_extract_all(text, '(?m)^#{1,6}\s+(.+)$', 1) as h from documents) where len(h) > 0",
}
