"""Structured Streaming twins of the incremental operators.

The watermark is a choice of ours: it bounds the state, and events later than it are left out. State is one
small value for each key, so a hot key costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce_stream(events: DataFrame, keys: list[str], ts: str, quiet: str, late: str) -> DataFrame:
    """Bursts as in incremental.debounce, each given out once when the watermark has passed its end."""
    burst = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("change_count"), F.min(ts).alias("first_changed_at"), F.max(ts).alias("last_changed_at"))
    return burst.select(*keys, "change_count", "first_changed_at", "last_changed_at", F.col("w.end").alias("eligible_at"))


def cooldown_stream(events: DataFrame, key: str, ts: str, seconds: float, late: str) -> DataFrame:
    """Events that pass as in incremental.cooldown, in the order in which micro-batches bring them."""
    schema = events.schema
    wait = pd.Timedelta(seconds=seconds)

    def fold(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # nothing came for so long that the next event passes anyway
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(batches).sort_values(ts)
        keep = []
        for t in rows[ts]:
            t0 = t.tz_localize(None) if t.tzinfo else t
            ok = last is None or t0 - last >= wait
            keep.append(ok)
            if ok:
                last = t0
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int((last + wait).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(fold, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def changed_stream(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Events whose value differs from the key's value before, as in incremental.changed."""
    schema = events.schema

    def fold(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, before = (True, state.get[0]) if state.exists else (False, None)
        rows = pd.concat(batches).sort_values(ts)
        keep = []
        for v in rows[value]:
            v = None if pd.isna(v) else str(v)
            keep.append(v != before if seen else v not in (None, ""))
            seen, before = True, v
        state.update((before,))
        yield rows[keep]

    return events.groupBy(key).applyInPandasWithState(fold, schema, "before string", "append", GroupStateTimeout.NoTimeout)
