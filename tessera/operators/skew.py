"""Joins of which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of the rows on, so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 1024
#: Below this number of rows no key is worth splitting.
HEAVY_FLOOR = 10_000


def heavy_keys(df: DataFrame, keys: list[str], rows: int, share: float = HEAVY_SHARE, floor: int = HEAVY_FLOOR) -> DataFrame | None:
    """The keys that hold at least ``share`` of ``rows``: at most 1 / share of them, whatever the input's size.

    Counted over all rows, with partial aggregation before the shuffle. Null keys are never heavy. None if there
    are too few rows for any heavy key.
    """
    if rows < floor:
        return None
    least = max(floor, int(rows * share))
    return df.select(*keys).na.drop().groupBy(*keys).count().where(F.col("count") >= least).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame | None, salt_by: list[str], salts: int = 32, how: str = "left", hint: str | None = "merge") -> DataFrame:
    """left join right on keys, with the left rows of heavy keys spread over ``salts`` partitions.

    ``right`` holds few rows per key; its rows of heavy keys are repeated for each salt. ``heavy`` has a
    bounded number of rows (see heavy_keys), which is why it is broadcast. No row is lost or doubled.
    """
    if heavy is None:
        return left.join(right.hint(hint) if hint else right, keys, how)
    flag = F.broadcast(heavy.withColumn("__heavy", F.lit(True)))
    l = left.join(flag, keys, "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")).otherwise(0)).drop("__heavy")
    r = right.join(flag, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__heavy")
    if hint:
        r = r.hint(hint)
    return l.join(r, [*keys, "__salt"], how).drop("__salt")
