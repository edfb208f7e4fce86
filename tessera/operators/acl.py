"""Page permissions down the tree: a page is readable if every restricted page above it, itself too, is.

Restrictions are marks in the hierarchy: each tree is swept once in the order of its entry numbers with the
restrictions that are open, so no closure of pages and ancestors is made. A missing lineage never makes
anything readable: pages of circles have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.hierarchy import inherited_marks


def principals(permissions: DataFrame) -> DataFrame:
    """(page_access_id, principal, role): a user's or a group's permission under one key, 'u:' or 'g:' and the id."""
    user = permissions.where("user_id is not null").select("page_access_id", F.concat(F.lit("u:"), "user_id").alias("principal"), "role")
    group = permissions.where("group_id is not null").select("page_access_id", F.concat(F.lit("g:"), "group_id").alias("principal"), "role")
    return user.unionByName(group)


def restrictions(access: DataFrame, granted: DataFrame, who: list[str]) -> DataFrame:
    """Marks of the restricted pages: whether someone who is all of these principals is granted all restrictions of
    the page, and is a writer in one of them; the name is the smallest id of its restrictions."""
    mine = granted.where(F.col("principal").isin(who)).groupBy(F.col("page_access_id").alias("name")).agg(F.bool_or(F.col("role") == "writer").alias("writes"))
    each = access.where("page_id is not null").select(F.col("id").alias("name"), F.col("page_id").alias("id")).join(mine.withColumn("reads", F.lit(True)), "name", "left")
    return each.groupBy("id").agg(F.min("name").alias("name"), F.bool_and(F.coalesce("reads", F.lit(False))).alias("every"), F.bool_or(F.coalesce("writes", F.lit(False))).alias("nearest"))


def page_access(tree: DataFrame, marks: DataFrame) -> DataFrame:
    """(page_id, direct, inherited, can_read, can_edit) of every page of a tree.

    A page without restrictions is readable and editable. Otherwise all its restrictions, its own and those
    above, must be granted, and editing takes the writer's role at the nearest restricted page.
    """
    found = inherited_marks(tree, marks).select("id", "direct", "inherited", "every", "nearest")
    both = tree.where("status = 'tree'").select("id").join(found, "id", "left")
    yes, no = F.lit(True), F.lit(False)
    return both.select(F.col("id").alias("page_id"), F.coalesce("direct", no).alias("direct"), F.coalesce("inherited", no).alias("inherited"), F.coalesce("every", yes).alias("can_read"), F.coalesce(F.col("every") & F.col("nearest"), yes).alias("can_edit"))


def nearest_restriction(tree: DataFrame, marks: DataFrame) -> DataFrame:
    """(page_id, page_access_id, depth) of the restriction that is nearest above; the smaller id of two at one page."""
    return inherited_marks(tree, marks).select(F.col("id").alias("page_id"), F.col("name").alias("page_access_id"), F.col("distance").alias("depth"))


def readers(chains: DataFrame, access: DataFrame, granted: DataFrame, members: DataFrame) -> DataFrame:
    """(page_access_id, user_id): who may read the pages whose nearest restriction it is.

    chains: page_access_id and page_id of each restricted page at or above. members: user_id, group_id. A user is
    granted a restriction directly or by any of their groups, one in one way and the next in another. Pages
    without restrictions are open to all and have no row.
    """
    user = granted.where("principal like 'u:%'").select("page_access_id", F.substring("principal", 3, 1000).alias("user_id"))
    group = granted.where("principal like 'g:%'").select("page_access_id", F.substring("principal", 3, 1000).alias("group_id")).join(members, "group_id").select("page_access_id", "user_id")
    held = user.unionByName(group).distinct()
    needed = chains.join(access.where("page_id is not null").select(F.col("id").alias("needed"), "page_id"), "page_id").select("page_access_id", "needed").distinct()
    total = needed.groupBy("page_access_id").agg(F.count("*").alias("n"))
    got = needed.join(held.withColumnRenamed("page_access_id", "needed"), "needed").groupBy("page_access_id", "user_id").agg(F.count("*").alias("k"))
    return got.join(total, "page_access_id").where("k = n").select("page_access_id", "user_id")


def readable_chunks(lineage: DataFrame, access: DataFrame) -> DataFrame:
    """(chunk_id, readable): whether every source page of a chunk is readable; one that isn't known isn't.

    Chunks without lineage have no row: absent means not readable.
    """
    return lineage.join(access.select("page_id", "can_read"), "page_id", "left").groupBy("chunk_id").agg(F.bool_and(F.coalesce("can_read", F.lit(False))).alias("readable"))
