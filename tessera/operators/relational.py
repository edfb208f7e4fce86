"""First rows, set differences, pages, quotas: the relational operators that have a name of their own."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key. The order must be total for a result that doesn't vary."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= keep).drop("__rn")


def winning_rows(df: DataFrame, keys: list[str], run: str, order: list[Column]) -> DataFrame:
    """All rows of the run that wins for each key: the run of the first row in the order."""
    winner = first_rows(df, keys, order).select(*keys, F.col(run).alias("__run"))
    return df.join(winner, keys).where(F.col(run) == F.col("__run")).drop("__run")


def set_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with action 'delete' (only in old) or 'insert' (only in new); repeated rows count once."""
    o, n = old.select(*keys).distinct(), new.select(*keys).distinct()
    return o.join(n, keys, "left_anti").withColumn("action", F.lit("delete")).unionByName(n.join(o, keys, "left_anti").withColumn("action", F.lit("insert")))


def three_way_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, action): 'insert', 'delete', or 'update' where a value differs, nulls being equal; one row per key on each side."""
    o = old.select(*keys, F.struct(*values).alias("__o"))
    n = new.select(*keys, F.struct(*values).alias("__n"))
    action = F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNull(), "delete").when(~F.col("__o").eqNullSafe(F.col("__n")), "update")
    return o.join(n, keys, "full").withColumn("action", action).where("action is not null").select(*keys, "action")


def divides(required: DataFrame, held: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """(group, complete): whether all items that a group requires are held. A group without items isn't in the result."""
    got = held.select(*item).distinct().withColumn("__held", F.lit(True))
    return required.select(*group, *item).join(got, item, "left").groupBy(*group).agg(F.bool_and(F.coalesce("__held", F.lit(False))).alias("complete"))


# Keyset pages

Field = tuple[str, bool]  #: a column and whether it descends


def keyset_after(fields: list[Field], values: list, backward: bool = False) -> Column:
    """Rows strictly behind (or before) the cursor in the mixed order of the fields, null values last."""
    out = F.lit(False)
    for (name, desc), value in reversed(list(zip(fields, values, strict=True))):
        c = F.col(name)
        if value is None:  # behind null there is nothing, before it all that isn't null
            ahead, same = (c.isNotNull() if backward else F.lit(False)), c.isNull()
        else:
            ahead, same = ((c < F.lit(value)) if desc != backward else (c > F.lit(value))), F.coalesce(c == F.lit(value), F.lit(False))
            ahead = F.coalesce(ahead, F.lit(not backward))
        out = ahead | (same & out)
    return out


def keyset_page(df: DataFrame, fields: list[Field], limit: int, after: list | None = None, before: list | None = None) -> DataFrame:
    """One row more than the page, whose presence says that there is a next page; backwards, the nearest rows first.

    Null values come last; a cursor may hold null.
    """
    backward = before is not None
    at = before if backward else after
    order = [(F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last()) if not backward else (F.col(c).asc_nulls_first() if d else F.col(c).desc_nulls_first()) for c, d in fields]
    return (df.where(keyset_after(fields, at, backward)) if at is not None else df).orderBy(*order).limit(limit + 1)


def encode_cursor(fields: list[Field], row: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps([[c, row[c]] for c, _ in fields], default=str).encode()).decode().rstrip("=")


def decode_cursor(fields: list[Field], cursor: str) -> list:
    """The cursor's values; a cursor of other fields, or of another order of them, is an error."""
    pairs = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    if [c for c, _ in pairs] != [c for c, _ in fields]:
        raise ValueError("the cursor doesn't belong to this order")
    return [v for _, v in pairs]


def offset_page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with the total of all rows beside each; empty past the end. The total is one count, not a window over all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


# Quotas

def quota_selection(df: DataFrame, kind: str, order: list[Column], quotas: dict[str, int], total: int, no_refill: list[str]) -> DataFrame:
    """First the best of each kind up to its quota, then the best of the rest up to ``total``, kinds in no_refill left out.

    The best of each kind are taken before the rest is ranked, so no window sees more than the candidates.
    """
    quota = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in quotas.items()], F.lit(0))
    most = total + max([*quotas.values(), 0])
    best = first_rows(df, [kind], order, most).withColumn("__k", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))
    chosen = best.withColumn("picked", F.when(F.col("__k") <= quota, 0).when(~F.col(kind).isin(no_refill), 1))
    return chosen.where("picked is not null").orderBy("picked", *order).limit(total).drop("__k")


def blend(direct: DataFrame, graph: DataFrame, key: str, rank: str, limit: int) -> DataFrame:
    """(key, origin, position): direct and graph results; a quarter of the places for graph, unused places to the other.

    Both lists are ranked results of bounded length.
    """
    d = direct.select(key, rank).orderBy(rank).limit(limit)
    g = graph.select(key, rank).join(d.select(key), key, "left_anti").orderBy(rank).limit(limit)
    many = g.agg(F.least(F.count("*"), F.greatest(F.lit(1), F.lit(limit // 4)), F.lit(limit - 1)).alias("share"))
    rows = d.withColumn("origin", F.lit("direct")).unionByName(g.withColumn("origin", F.lit("graph")))
    own = F.row_number().over(Window.partitionBy("origin").orderBy(rank))
    first = F.when(F.col("origin") == "direct", F.col("own") <= limit - F.col("share")).otherwise(F.col("own") <= F.col("share"))
    ranked = rows.withColumn("own", own).crossJoin(F.broadcast(many)).withColumn("late", (~first).cast("int"))
    kept = ranked.orderBy("late", F.col("origin"), "own").limit(limit)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("late", "origin", "own"))
    return kept.withColumn("position", place).select(key, "origin", "position")
