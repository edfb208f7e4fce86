"""Compilation runs: requests that meet a run under way, barriers, convergence, what is reserved and planned."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesced_requests(requests: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, id, outcome, into): what becomes of each request for a run, in order of time.

    requests: key, id, asked_at, ended_at (null: not ended). Without an active run a request creates one
    ('created'). Within ``seconds`` of the active run's request it joins it ('coalesced'); later it asks for
    another run behind it ('rerun'). A fold in order over sorted partitions, with one run as its state, so a
    key of any length streams through. Rows of null key or time are left out.
    """
    wait = pd.Timedelta(seconds=seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = active = since = until = None
        for rows in batches:
            out = []
            for k, name, asked, ended in zip(rows[key], rows["id"], rows["asked_at"], rows["ended_at"]):
                if k != at or (not pd.isna(until) and until <= asked):
                    at, active, since, until = k, name, asked, ended
                    out.append((k, name, "created", name))
                else:
                    out.append((k, name, "coalesced" if asked - since <= wait else "rerun", active))
            yield pd.DataFrame(out, columns=[key, "id", "outcome", "into"])

    live = requests.where(F.col(key).isNotNull() & F.col("asked_at").isNotNull()).select(key, "id", "asked_at", "ended_at")
    kind = live.schema[key].dataType.simpleString()
    return live.repartition(key).sortWithinPartitions(key, "asked_at", "id").mapInPandas(run, f"{key} {kind}, id string, outcome string, into string")


def barrier(rows: DataFrame, run: str) -> DataFrame:
    """(run, pages, open_pages, open_images, next_phase): pages first, then images, then their merge, then the end.

    rows: run, status, merge_status, expected and done image counts; null counts are none.
    """
    no = lambda c: F.coalesce(F.col(c), F.lit(0))
    closed = F.col("status").isin("succeeded", "failed", "skipped", "cancelled")
    g = rows.groupBy(run).agg(F.count("*").alias("pages"), F.count_if(~closed).alias("open_pages"), F.sum(F.greatest(F.lit(0), no("expected") - no("done"))).alias("open_images"), F.count_if(F.col("merge_status") == "pending").alias("unmerged"))
    phase = F.when(F.col("open_pages") > 0, "pages").when(F.col("open_images") > 0, "images").when(F.col("unmerged") > 0, "image_merge").otherwise("finalizing")
    return g.select(run, "pages", "open_pages", "open_images", phase.alias("next_phase"))


def interrupted(rows: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """(id, run, status): open rows of runs that have ended, with the status they converge to: cancelled with their run, else failed."""
    ended = runs.where(F.col("status").isin("succeeded", "partial", "failed", "cancelled")).select(F.col("id").alias(run), F.col("status").alias("ended"))
    return rows.where(F.col("status").isin("queued", "running")).join(ended, run).select("id", run, F.when(F.col("ended") == "cancelled", "cancelled").otherwise("failed").alias("status"))


def reserved(rows: DataFrame, run: str, order: list[Column], most: int) -> DataFrame:
    """Queued rows that may start: so many of each run that no more than ``most`` of it are under way. Ordered, with their place."""
    busy = rows.where("status = 'running'").groupBy(run).agg(F.count("*").alias("busy"))
    place = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    queued = rows.where("status = 'queued'").withColumn("place", place).where(F.col("place") <= most)
    return queued.join(busy, run, "left").where(F.col("place") <= most - F.coalesce("busy", F.lit(0))).drop("busy")


def backoff(attempt: Column, first: int = 30, most: int = 1800) -> Column:
    """Seconds to wait after the n-th failure: doubling from ``first`` up to ``most``."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2), F.least(attempt, F.lit(30)) - 1)).cast("int")
