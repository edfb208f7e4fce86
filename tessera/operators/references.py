"""References to records that don't exist, were deleted, or came later than the reference.

References of all tables and the keys they point at are two streams, partitioned and sorted alike by
(target table, key), and merged once (a sort-merge join). The parent's side carries the interval in
which the parent was valid: from its creation to its deletion, open if it wasn't deleted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import heavy_keys, salted_join
from tessera.sources.tables import current_rows, ref_key


@dataclass(frozen=True)
class Reference:
    """table.column points at target's ids."""

    table: str
    column: str
    target: str


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def _narrow(df: DataFrame, tag: str, ref: str | None) -> DataFrame:
    """What of a table goes through the shuffles: id, times, and the reference if there is one."""
    parts = [F.lit(tag).alias("tab"), F.col("id").cast("string").alias("id"), *(_column(df, c, "timestamp_ntz").alias(c) for c in ("created_at", "updated_at", "deleted_at"))]
    if ref:
        parts.append(ref_key(F.col(ref).cast("string")).alias("key"))
    return df.select(*parts)


def orphan_references(tables: dict[str, DataFrame], references: list[Reference], salts: int = 32) -> DataFrame:
    """Every current, not deleted row whose reference has no valid parent.

    Columns: table_name, ref_column, target, row_id, ref_key, created_at, status. status is 'missing' (no
    current row of the target has that id), else 'deleted' (the parent's current row has deleted_at), else
    'late' (the parent was created after the referring row).

    Null or blank references are no references. Rows with a null id are left out. A null created_at on
    either side is never late. Tables may be empty, hold repeated rows and earlier states, and have further
    columns of any name; deleted_at and updated_at may be absent.
    """
    refs_raw = reduce(DataFrame.unionByName, (_narrow(tables[r.table], f"{r.table}.{r.column}.{r.target}", r.column) for r in references))
    ways = {r.target for r in references}
    parents_raw = reduce(DataFrame.unionByName, (_narrow(tables[t], t, None) for t in sorted(ways)))

    part = lambda i: F.element_at(F.split("tab", r"\."), i)
    refs = current_rows(refs_raw, ["tab", "id"]).where("key is not null and deleted_at is null").select(part(1).alias("table_name"), part(2).alias("ref_column"), part(3).alias("target"), F.col("id").alias("row_id"), "key", "created_at")
    parents = current_rows(parents_raw, ["tab", "id"]).select(F.col("tab").alias("target"), F.lower("id").alias("key"), F.col("created_at").alias("valid_from"), F.col("deleted_at").alias("valid_to"), F.lit(True).alias("present"))

    total = sum(tables[t].count() for t in {r.table for r in references})  # from the files' footers
    heavy = heavy_keys(refs_raw.select(part(3).alias("target"), "key"), ["target", "key"], total)
    status = F.when(F.col("present").isNull(), "missing").when(F.col("valid_to").isNotNull(), "deleted").when(F.col("valid_from") > F.col("created_at"), "late")
    return (
        salted_join(refs, parents, ["target", "key"], heavy, ["row_id"], salts)
        .withColumn("status", status)
        .where("status is not null")
        .select("table_name", "ref_column", "target", "row_id", F.col("key").alias("ref_key"), "created_at", "status")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, month of created_at and status. A null created_at is month null."""
    return orphans.groupBy("table_name", "ref_column", F.date_format("created_at", "yyyy-MM").alias("month"), "status").agg(F.count("*").alias("n_orphans"))
