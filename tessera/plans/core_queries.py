"""The p4_ and p5_ queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.hierarchy import hierarchy, page_nodes, paths
from tessera.operators.references import Reference, orphan_references, orphan_report
from tessera.session import Workspace
from tessera.sources.tables import read_table

REFERENCES = [
    Reference("page_permissions", "page_access_id", "page_access"),
    Reference("attachments", "page_id", "pages"),
    Reference("knowledge_space_compile_run_pages", "run_id", "knowledge_space_compile_runs"),
    Reference("knowledge_sources", "source_page_id", "pages"),
]


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted({r.table for r in REFERENCES} | {r.target for r in REFERENCES})
    return orphan_references({t: read_table(spark, sf_dir, t) for t in names}, REFERENCES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(page_nodes(read_table(spark, sf_dir, "pages")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _hierarchy(spark, sf_dir)
    return tree.where("status != 'tree' or not (grp <=> root_grp)").select(F.col("id").alias("page_id"), "root_id")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    tree = ws.table(_hierarchy(spark, sf_dir), "tree")
    return (
        tree.join(paths(tree), "id", "left")
        .select(F.col("id").alias("page_id"), F.col("grp").alias("space_id"), "status", "root_id", "depth", F.concat_ws("/", "path").alias("path"), "n_descendants", "enter", "leave")
    )


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with each of its descendants."""
    ws = Workspace(spark)
    tree = ws.table(_hierarchy(spark, sf_dir), "tree")
    pairs = paths(tree).select(F.col("id").alias("descendant_id"), F.posexplode("path").alias("i", "page_id"), (F.size("path") - 1).alias("depth"))
    return pairs.where("i < depth").select("page_id", "descendant_id", (F.col("depth") - F.col("i")).alias("distance"))


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p5_found, p5_hierarchy, p5_descendants)}

_REF = r"nullif(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '')"


def _orphan_sql() -> str:
    arms = []
    for r in REFERENCES:
        live = "r.deleted_at is null and" if r.table in ("attachments", "knowledge_sources") else ""
        gone = "p.deleted_at is not null" if r.target == "pages" else "false"
        arms.append(f"""
        select '{r.table}' as table_name, '{r.column}' as ref_column, r.id as row_id, r.created_at,
               case when p.id is null then 'missing' when {gone} then 'deleted' else 'late' end as status
        from (select *, {_REF.format(r.column)} as key from (select distinct on (id) * from {r.table} order by id, updated_at desc)) r
        left join (select distinct on (id) * from {r.target} order by id, updated_at desc) p on p.id = r.key
        where {live} r.key is not null and (p.id is null or {gone} or p.created_at > r.created_at)""")
    return " union all ".join(arms)


_TREE = f"""
with recursive cur as (select distinct on (id) id, {_REF.format("parent_page_id")} as parent, space_id from pages order by id, updated_at desc),
node as (select c.id, p.id as parent, c.space_id from cur c left join cur p on p.id = c.parent),
walk(id, root_id, root_space, depth, path) as (
  select id, id, space_id, 0, id::varchar from node where parent is null
  union all
  select n.id, w.root_id, w.root_space, w.depth + 1, w.path || '/' || n.id from node n join walk w on n.parent = w.id),
rootless as (select id, parent from node where id not in (select id from walk)),
chase(id, cur_id, step) as (
  select id, id, 0 from rootless
  union all
  select c.id, r.parent, c.step + 1 from chase c join rootless r on r.id = c.cur_id where c.step < (select count(*) from rootless)),
final as (select id, cur_id as on_circle from chase where step = (select count(*) from rootless)),
circle(start_id, cur_id, step) as (
  select distinct on_circle, on_circle, 0 from final
  union all
  select c.start_id, r.parent, c.step + 1 from circle c join rootless r on r.id = c.cur_id where c.step < (select count(*) from rootless)),
least_id as (select start_id, min(cur_id) as root_id from circle group by 1)
"""
SQL = {
    "p4_found": f"select table_name, row_id from ({_orphan_sql()})",
    "p4_report": f"select table_name, ref_column, strftime(created_at, '%Y-%m') as month, status, count(*) as n_orphans from ({_orphan_sql()}) group by all",
    "p5_found": _TREE + """
select w.id as page_id, w.root_id from walk w join node n on n.id = w.id where n.space_id is distinct from w.root_space
union all select f.id, l.root_id from final f join least_id l on l.start_id = f.on_circle""",
    "p5_descendants": _TREE + """, pairs(page_id, descendant_id, distance) as (
  select parent, id, 1 from node where parent is not null and id in (select id from walk)
  union all
  select n.parent, p.descendant_id, p.distance + 1 from pairs p join node n on n.id = p.page_id where n.parent is not null)
select * from pairs""",
}
