"""Events in order: debounce, throttle, cooldown, change detection, digests. The streaming twins are in tessera.streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def debounce(events: DataFrame, keys: list[str], ts: str, quiet: str) -> DataFrame:
    """One row for each burst of a key: first and last change, how many, and when it is quiet for long enough.

    A burst ends when nothing comes for ``quiet`` (a duration such as '2 hours'); the bounds don't depend on
    the order in which events arrive. Null keys and times are left out.
    """
    live = events.where(" and ".join(f"{c} is not null" for c in [*keys, ts]))
    burst = live.groupBy(*keys, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("change_count"), F.min(ts).alias("first_changed_at"), F.max(ts).alias("last_changed_at"))
    return burst.select(*keys, "change_count", "first_changed_at", "last_changed_at", F.col("w.end").cast(events.schema[ts].dataType).alias("eligible_at"))


def due(bursts: DataFrame, now: str, limit: int) -> DataFrame:
    """Bursts that are quiet at ``now``, the earliest first."""
    return bursts.where(F.col("eligible_at") <= F.lit(now).cast("timestamp_ntz")).orderBy("eligible_at", *[c for c in bursts.columns if c != "eligible_at"]).limit(limit)


def changed(events: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their key; a first value counts unless it is null or empty."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = events.withColumn("__before", F.lag(value).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    keep = F.when(F.col("__first"), F.coalesce(F.col(value).cast("string"), F.lit("")) != "").otherwise(~F.col(value).eqNullSafe(F.col("__before")))
    return rows.where(keep).drop("__before", "__first")


def _passing(keys: list[str], ts: str, seconds: float):
    wait = pd.Timedelta(seconds=seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for rows in batches:
            keep = []
            for key, t in zip(zip(*(rows[k] for k in keys)), rows[ts]):
                ok = key != at or t - last >= wait
                keep.append(ok)
                if ok:
                    at, last = key, t
            yield rows[keep]

    return run


def cooldown(events: DataFrame, keys: list[str], ts: str, seconds: float) -> DataFrame:
    """Events that pass: the first of a key, then each that comes ``seconds`` or more after the last that passed.

    What passes depends on what passed before, so it is a fold in order. It runs over sorted partitions with
    one key and one time as its state, so a key of any length streams through and is never held. Events of
    one time are taken in the order of the other columns; null keys and times are left out.
    """
    live = events.where(" and ".join(f"{c} is not null" for c in [*keys, ts]))
    rest = [c for c in events.columns if c not in (*keys, ts)]
    return live.repartition(*keys).sortWithinPartitions(*keys, ts, *rest).mapInPandas(_passing(keys, ts, seconds), events.schema)


def digest(events: DataFrame, keys: list[str], ts: str, item: str, hours: int) -> DataFrame:
    """(keys, opened_at, due_at, items, n): what gathers from the first event of a digest until ``hours`` later."""
    opened = cooldown(events.select(*keys, ts).distinct(), keys, ts, hours * 3600).select(*keys, F.col(ts).alias("opened_at"))
    w = Window.partitionBy(*keys).orderBy("__at", "__kind")
    stream = opened.select(*keys, F.col("opened_at").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(events.schema[item].dataType).alias(item)).unionByName(events.select(*keys, F.col(ts).alias("__at"), F.lit(1).alias("__kind"), item))
    owned = stream.withColumn("opened_at", F.last(F.when(F.col("__kind") == 0, F.col("__at")), ignorenulls=True).over(w)).where("__kind = 1")
    return owned.groupBy(*keys, "opened_at").agg(F.array_sort(F.collect_set(item)).alias("items"), F.count("*").alias("n")).withColumn("due_at", F.col("opened_at") + F.expr(f"interval {hours} hours"))
