"""Windowed statistics of live events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, length: str, late: str) -> DataFrame:
    """(channel, start, n, mean): counts and means by channel and window of ``ts``; events later than ``late`` are dropped. Works alike on a batch."""
    grouped = events.withWatermark("ts", late).groupBy("channel", F.window("ts", length).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("amp").alias("mean")).select("channel", F.col("w.start").alias("start"), "n", "mean")


def sliding(events: DataFrame, length: str, step: str, late: str) -> DataFrame:
    """(channel, start, n) of windows of ``length`` every ``step``."""
    grouped = events.withWatermark("ts", late).groupBy("channel", F.window("ts", length, step).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("channel", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(unit, start, n): bursts of a unit's events with no pause longer than ``gap``."""
    grouped = events.withWatermark("ts", late).groupBy("unit", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("unit", F.col("w.start").alias("start"), "n")


def refractory(events: DataFrame, period: int) -> DataFrame:
    """(event_id, unit, t) of live events that do not follow their unit's previous one within ``period``.

    The state of a unit is the time of its last event. Events of one batch are put in order of t and event_id; one that comes in a
    later batch than an event after it is held against that event's time, so it is dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
        kept = []
        for event, t in zip(rows["event_id"], rows["t"], strict=True):
            if last is None or t - last > period:
                kept.append((event, key[0], t))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(kept, columns=["event_id", "unit", "t"])

    plain = events.select("event_id", "unit", "t")
    return plain.groupBy("unit").applyInPandasWithState(step, "event_id long, unit long, t long", "last long", "append", GroupStateTimeout.NoTimeout)
