"""Batch twins of the stateful operators: taps, bursts, as-of outcomes, over one keyed, ordered table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def double_taps(events: DataFrame, key: str, order: list[str], ts: str, tap: Column, window_s: float) -> DataFrame:
    """The rows that complete a double tap: the second of each pair of taps at most window_s apart with nothing between."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("tap", tap).withColumn("gap", _seconds(ts) - F.lag(_seconds(ts)).over(w)).withColumn("tapped", F.lag("tap").over(w))
    new = (~F.col("tap")) | ~F.coalesce("tapped", F.lit(False)) | (F.col("gap") > window_s)
    runs = marked.withColumn("run", F.sum(new.cast("int")).over(w)).filter("tap")
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(key, "run").orderBy(*order))).filter("place % 2 = 0").drop("tap", "gap", "tapped", "run", "place")


def bursts(events: DataFrame, key: str, order: list[str], ts: str, gap_s: float) -> DataFrame:
    """key, burst, first_ts, last_ts, n: runs of rows no more than gap_s apart."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = _seconds(ts) - F.lag(_seconds(ts)).over(w)
    runs = events.withColumn("new", F.coalesce((gap > gap_s).cast("int"), F.lit(1))).withColumn("burst", F.sum("new").over(w))
    return runs.groupBy(key, "burst").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def outcomes(events: DataFrame, key: str, order: list[str], ts: str, proposal: Column, outcome: Column, columns: list[str], within_s: float) -> DataFrame:
    """Each proposal row with the first later outcome row of its key within the time: one pass in descending order, no range join."""
    after = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    cell = F.when(outcome, F.struct(F.col(ts).alias("ts"), *[F.col(c) for c in columns]))
    found = events.withColumn("hit", F.last(cell, ignorenulls=True).over(after)).filter(proposal)
    late = _seconds("hit.ts") - _seconds(ts) > within_s
    return found.withColumn("hit", F.when(~late, F.col("hit")))


def gesture_states(events: DataFrame, key: str, order: list[str], ts: str, ttl_s: float) -> DataFrame:
    """key, expired, live: rows whose state had timed out when the next came, and those that carried over."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.lead(_seconds(ts)).over(w) - _seconds(ts)
    return events.withColumn("gap", gap).groupBy(key).agg(F.count_if(F.col("gap") > ttl_s).alias("expired"), F.count_if(F.col("gap") <= ttl_s).alias("live"))
