"""Parent-child rows to full hierarchies: cycles, roots, depths, intervals, paths and descendants.

1. Leaves are peeled to expose cycles. Peeling 2^k times leaves the nodes that have a descendant 2^k
   steps below them, that is, the image of the parent function applied 2^k times. Squaring that function
   therefore does 2^k rounds of peeling with k joins; nodes that came past a root drop out on the way, and
   what no round can peel any more lies on a cycle.
2. The rest is a forest. Its Euler tour is a linked list of two elements per node, made from first
   children and next siblings, and the list is ranked in parallel by pointer jumping.
3. Ranks are entry and exit numbers: they give depth, subtree sizes, ancestors, paths and descendants.

Every round is written to the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.skew import heavy_keys, salted_join
from tessera.session import Workspace, tasks
from tessera.sources.tables import current_rows, ref_key

#: Entries of one tree that one sweep handles at a time when paths are written.
SWEEP_BLOCK = 8192


def _numbered(ws: Workspace, nodes: DataFrame, salts: int) -> DataFrame:
    """(n, p, id, grp): a number for each node, its parent's number (null for roots)."""
    base = ws.table(nodes.select("id", "parent", "grp").withColumn("n", F.monotonically_increasing_id()), "nodes")
    rows = base.count()
    keyed = base.select("n", "id", "grp", F.col("parent").alias("key"))
    parents = base.select(F.lower("id").alias("key"), F.col("n").alias("p"))
    return ws.table(salted_join(keyed, parents, ["key"], heavy_keys(keyed, ["key"], rows), ["n"], salts, hint=None).select("n", "p", "id", "grp"), "numbered")


def _squared(ws: Workspace, state: DataFrame, rows: int, salts: int) -> tuple[DataFrame, int]:
    ahead = state.select(F.col("v").alias("a"), F.col("a").alias("b"))
    step = salted_join(state, ahead, ["a"], heavy_keys(state, ["a"], rows), ["v"], salts, how="inner", hint=None)
    after, rows = ws.counted(step.select("v", F.col("b").alias("a")), "true", "peel")
    ws.drop(state)
    return after, rows


def _peel(ws: Workspace, numbered: DataFrame, salts: int) -> tuple[DataFrame, int]:
    """(v, a): the nodes that no peeling removes or that hang below such, each with a node on its cycle; and their number.

    As long as any node of a tree is left, a round removes some. When none is removed, those left run in circles,
    and squaring goes on until all have come from the paths that lead to a circle onto it.
    """
    state, rows = ws.counted(numbered.where("p is not null").select(F.col("n").alias("v"), F.col("p").alias("a")), "true", "peel")
    before = -1
    while rows and rows != before:
        before = rows
        state, rows = _squared(ws, state, rows, salts)
    left = -1
    while rows:
        now = state.agg(F.count_distinct("a")).first()[0]
        if now == left:
            break
        left = now
        state, rows = _squared(ws, state, rows, salts)
    return state, rows


def _smallest_on_circle(ws: Workspace, numbered: DataFrame, on: DataFrame) -> DataFrame:
    """(a, root_id): for each node on a cycle, the smallest id of its cycle."""
    state = ws.table(numbered.join(on.select(F.col("a").alias("n")), "n", "left_semi").select("n", "p", F.col("p").alias("a"), F.col("id").alias("m")), "circle")
    while True:
        ahead = state.select(F.col("n").alias("p"), F.col("m").alias("m2"))
        if state.join(ahead, "p").where("m != m2").isEmpty():
            return state.select(F.col("n").alias("a"), F.col("m").alias("root_id"))
        ahead = state.select(F.col("n").alias("a"), F.col("a").alias("a2"), F.col("m").alias("m2"))
        after = ws.table(state.join(ahead, "a").select("n", "p", F.col("a2").alias("a"), F.least("m", "m2").alias("m")), "circle")
        ws.drop(state)
        state = after


def _tour(ws: Workspace, forest: DataFrame, salts: int) -> DataFrame:
    """(e, a, w): the Euler tour's list; element 2n enters node n, 2n + 1 leaves it; a is null at the end.

    Siblings are linked in descending order of their numbers. The children of a parent with very many are
    linked in ``salts`` groups, and the groups then to each other, so that no task sorts them all.
    """
    rows = forest.count()
    kids = forest.where("p is not null").select("n", "p")
    heavy = heavy_keys(kids, ["p"], rows)
    if heavy is None:
        kids = kids.withColumn("s", F.lit(0).cast("long"))
    else:
        flag = F.broadcast(heavy.withColumn("__heavy", F.lit(True)))
        kids = kids.join(flag, "p", "left").withColumn("s", F.when(F.col("__heavy"), F.pmod(F.xxhash64("n"), F.lit(salts))).otherwise(0).cast("long")).drop("__heavy")
    inner = Window.partitionBy("p", "s").orderBy(F.col("n").desc())
    kids = ws.table(kids.withColumn("next", F.lead("n").over(inner)).withColumn("k", F.row_number().over(inner)), "kids")
    outer = Window.partitionBy("p").orderBy("s")
    heads = kids.where("k = 1").select("p", "s", F.col("n").alias("first"))
    heads = heads.withColumn("jump", F.lead("first").over(outer)).withColumn("k", F.row_number().over(outer))
    linked = kids.where("next is not null").select("n", "p", "next").unionByName(kids.where("next is null").select("n", "p", "s").join(heads.select("p", "s", "jump"), ["p", "s"]).select("n", "p", F.col("jump").alias("next")))
    enter = forest.select("n").join(heads.where("k = 1").select(F.col("p").alias("n"), "first"), "n", "left").select((F.col("n") * 2).alias("e"), F.coalesce(F.col("first") * 2, F.col("n") * 2 + 1).alias("a"), F.lit(1).cast("long").alias("d"))
    leave = linked.select("n", "p", "next").unionByName(forest.where("p is null").select("n", "p", F.lit(None).cast("long").alias("next"))).select((F.col("n") * 2 + 1).alias("e"), F.coalesce(F.col("next") * 2, F.col("p") * 2 + 1).alias("a"), F.lit(-1).cast("long").alias("d"))
    return enter.unionByName(leave)


def _ranked(ws: Workspace, tour: DataFrame) -> DataFrame:
    """(e, r, d, last): elements from e to the end of its list, their summed weights, the list's end.

    Pointer jumping: in each round every element adds what the element it points at has gathered, and
    points twice as far. Each element is pointed at by one other at most, so no key is heavy. Elements of a
    list that has ended are set aside.
    """
    state, running = ws.counted(tour.select("e", "a", F.lit(1).cast("long").alias("r"), "d", F.col("e").alias("last")), "a is not null", "rank")
    while running:
        x, y = state.where("a is not null"), state.select(F.col("e").alias("a"), F.col("a").alias("a2"), F.col("r").alias("r2"), F.col("d").alias("d2"), F.col("last").alias("l2"))
        moved = x.join(y, "a").select("e", F.col("a2").alias("a"), (F.col("r") + F.col("r2")).alias("r"), (F.col("d") + F.col("d2")).alias("d"), F.col("l2").alias("last"))
        after, running = ws.counted(state.where("a is null").unionByName(moved), "a is not null", "rank")
        ws.drop(state)
        state = after
    return state


def hierarchy(nodes: DataFrame, ws: Workspace | None = None, salts: int = 32) -> DataFrame:
    """For each node its root, depth and interval; nodes without a root are named as cyclic.

    nodes: id, parent (as written), grp (any value, such as the space), one row per id. Result: id, grp,
    root_id, root_grp, depth, enter, leave, n_descendants, status, n, p. status is 'tree', 'circle' (on a
    cycle, its own parent included) or 'below' (its ancestors end in a cycle); for the latter two root_id
    is the smallest id on the cycle and depth and interval are null. A node is a descendant of another if
    their root is the same and its enter lies between the other's enter and leave.

    A null or blank parent, or one that is not among the ids, makes a root. Null ids are left out. Empty
    input gives an empty result.
    """
    ws = ws or Workspace(nodes.sparkSession)
    numbered = _numbered(ws, nodes.where("id is not null").select("id", ref_key("parent").alias("parent"), "grp"), salts)
    cyclic, endless = _peel(ws, numbered, salts)
    forest = ws.table(numbered.join(cyclic.select(F.col("v").alias("n")), "n", "left_anti"), "forest") if endless else numbered
    ranks = _ranked(ws, _tour(ws, forest, salts))

    # Read from its end, the tour is again an Euler tour, with the siblings in rising order; ranks count from there.
    n = F.shiftright("e", 1)
    spans = ranks.groupBy(n.alias("n")).agg(
        F.max(F.when(F.col("e") % 2 == 1, F.col("r") - 1)).alias("enter"), F.max(F.when(F.col("e") % 2 == 0, F.col("r") - 1)).alias("leave"), F.max(F.when(F.col("e") % 2 == 0, -F.col("d"))).cast("int").alias("depth"), F.max(F.shiftright("last", 1)).alias("root")
    )
    spans = ws.table(forest.join(spans, "n"), "spans")
    roots = spans.where("depth = 0").select("root", F.col("id").alias("root_id"), F.col("grp").alias("root_grp"))
    trees = salted_join(spans, roots, ["root"], heavy_keys(spans, ["root"], spans.count()), ["n"], salts, how="inner", hint=None)
    trees = trees.select("id", "grp", "root_id", "root_grp", "depth", "enter", "leave", F.expr("(leave - enter - 1) div 2").alias("n_descendants"), F.lit("tree").alias("status"), "n", "p")
    if not endless:
        return trees
    on = cyclic.select("a").distinct()
    circles = ws.table(_smallest_on_circle(ws, numbered, on), "circles")
    rest = (
        salted_join(cyclic, circles, ["a"], heavy_keys(cyclic, ["a"], endless), ["v"], salts, how="inner", hint=None).join(numbered.withColumnRenamed("n", "v"), "v").join(on.select(F.col("a").alias("v"), F.lit(True).alias("on")), "v", "left")
        .select("id", "grp", "root_id", F.lit(None).cast("string").alias("root_grp"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("enter"), F.lit(None).cast("long").alias("leave"), F.lit(None).cast("long").alias("n_descendants"), F.when(F.col("on"), "circle").otherwise("below").alias("status"), F.col("v").alias("n"), "p")
    )
    return trees.unionByName(rest)


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (root_id, block, enter); keeps the stack of open ancestors."""
    at, stack = None, []
    for rows in batches:
        out_id, out_path = [], []
        for root, block, enter, leave, node, label, mine in zip(rows.root_id, rows.block, rows.enter, rows.leave, rows.id, rows.label, rows.mine):
            if (root, block) != at:
                at, stack = (root, block), []
            while stack and stack[-1][0] < enter:
                stack.pop()
            stack.append((leave, label))
            if mine:
                out_id.append(node)
                out_path.append([x for _, x in stack])
        yield pd.DataFrame({"id": pd.Series(out_id, dtype=object), "path": pd.Series(out_path, dtype=object)})


def paths(tree: DataFrame, block: int = SWEEP_BLOCK, label: str = "id") -> DataFrame:
    """(id, path): the labels, by default the ids, from the root to each node of a tree, from the intervals alone.

    A tree is swept in blocks of ``block`` entry numbers; a node is repeated in the later blocks that its
    interval reaches into, so each block begins with its open ancestors and a huge tree is shared by many
    tasks. Cyclic nodes have no path and no row here.
    """
    t = tree.where("status = 'tree'").select("id", "root_id", "enter", "leave", F.col(label).alias("label"))
    first, last = F.expr(f"enter div {block}"), F.expr(f"leave div {block}")
    rows = t.withColumn("block", F.explode(F.sequence(first, last))).withColumn("mine", F.col("block") == first)
    rows = rows.repartition(tasks(tree.sparkSession), "root_id", "block").sortWithinPartitions("root_id", "block", "enter")
    return rows.select("root_id", "block", "enter", "leave", "id", "label", "mine").mapInPandas(_sweep, "id string, path array<string>")


def _inherit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (root_id, block, enter, marks first); keeps the stack of open marks with what holds below each."""
    at, stack = None, []
    for rows in batches:
        out = []
        for root, block, enter, leave, depth, node, name, every, nearest in zip(rows.root_id, rows.block, rows.enter, rows.leave, rows.depth, rows.id, rows.name, rows.every, rows.nearest):
            if (root, block) != at:
                at, stack = (root, block), []
            while stack and stack[-1][0] < enter:
                stack.pop()
            if node is None:
                stack.append((leave, depth, name, bool(every) and (not stack or stack[-1][3]), bool(nearest)))
            elif stack:
                _, above, name, every, nearest = stack[-1]
                own = above == depth
                out.append((node, len(stack), own, len(stack) > own, name, depth - above, every, nearest))
        yield pd.DataFrame(out, columns=["id", "n_marks", "direct", "inherited", "name", "distance", "every", "nearest"])


def inherited_marks(tree: DataFrame, marks: DataFrame, block: int = SWEEP_BLOCK) -> DataFrame:
    """(id, n_marks, direct, inherited, name, distance, every, nearest): the nodes that have a mark or are below one.

    marks: id, name, every, nearest, at most one row for each node. n_marks of them are at the node (direct) or
    at nodes above it (inherited); ``every`` is true if it is in all of them; name, nearest and distance (in
    steps up) are of the nearest. Only marks are repeated in the blocks that their intervals reach into; a node
    is one row, so the work doesn't grow with the depth of trees. Cyclic nodes have no row.
    """
    t = tree.where("status = 'tree'").select("id", "root_id", "enter", "leave", "depth")
    first, last = F.expr(f"enter div {block}"), F.expr(f"leave div {block}")
    own = t.select("root_id", first.alias("block"), "enter", "leave", "depth", F.lit(1).alias("kind"), "id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("boolean").alias("every"), F.lit(None).cast("boolean").alias("nearest"))
    mark = t.join(marks, "id").withColumn("block", F.explode(F.sequence(first, last)))
    mark = mark.select("root_id", "block", "enter", "leave", "depth", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), "name", "every", "nearest")
    rows = own.unionByName(mark).repartition(tasks(tree.sparkSession), "root_id", "block").sortWithinPartitions("root_id", "block", "enter", "kind")
    return rows.drop("kind").mapInPandas(_inherit, "id string, n_marks int, direct boolean, inherited boolean, name string, distance int, every boolean, nearest boolean")


def page_nodes(pages: DataFrame) -> DataFrame:
    """Current pages, deleted ones too, as nodes of the hierarchy."""
    p = pages.select("id", "parent_page_id", "space_id", "updated_at")
    return current_rows(p).select("id", F.col("parent_page_id").alias("parent"), F.col("space_id").alias("grp"))
