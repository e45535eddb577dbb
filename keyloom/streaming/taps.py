"""Gestures and corrections in event streams, with keyed state and timeouts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "session string, ord long, ts timestamp"


def double_taps(events: DataFrame, window_s: float = 0.25, late: str = "10 seconds", ttl_ms: int = 60_000) -> DataFrame:
    """The events(session, ord, ts, is_tap) that complete a double tap, as a stream.

    State is the last open tap of a session; it goes when the watermark passes it by ttl_ms. Rows of a micro-batch are
    ordered by (ts, ord); a tap that comes after a later one of its session starts anew.
    """

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "ord"])
        open_us = state.get[0] if state.exists else None
        hits, last = [], None
        for ts, ord_, tap in zip(rows["ts"], rows["ord"], rows["is_tap"]):
            now = last = int(ts.value // 1000)
            if not tap:
                open_us = None
            elif open_us is not None and 0 <= now - open_us <= window_s * 1e6:
                hits.append((key[0], int(ord_), ts))
                open_us = None
            else:
                open_us = now
        if open_us is None:
            if state.exists:
                state.remove()
        else:
            state.update((open_us,))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), last // 1000) + ttl_ms)
        yield pd.DataFrame(hits, columns=["session", "ord", "ts"])

    keyed = events.select(F.col("session").cast("string"), F.col("ord").cast("long"), F.col("ts").cast("timestamp"), F.col("is_tap").cast("boolean"))
    return keyed.withWatermark("ts", late).groupBy("session").applyInPandasWithState(step, SCHEMA, "open long", "append", GroupStateTimeout.EventTimeTimeout)


def counts_by_window(events: DataFrame, size: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """start, kind, n of events(ts, kind), late rows dropped beyond the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "kind").agg(F.count("*").alias("n")).select("window.start", "kind", "n")


def bursts(events: DataFrame, gap: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """session, start, end, n: runs of events(session, ts) with no longer gap."""
    return events.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("session", "w.start", "w.end", "n")


def new_lines(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of a rotated append log, each line once: events(ts, line)."""
    return events.withColumn("line_hash", F.xxhash64("line")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["line_hash", "line"])
