"""Ranking, gaps, latest rows, top-k, percentiles, ordered frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_two(df: DataFrame, keys: list[str], score: str, text: str) -> DataFrame:
    """keys, best, best_score, second, margin. Scores count as equal within six decimals; ties go to the smaller text."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 6)), text)
    ranked = df.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    pick = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c)))
    return ranked.groupBy(*keys).agg(pick(text, 1).alias("best"), F.round(pick(score, 1), 6).alias("best_score"), pick(text, 2).alias("second"), F.round(pick(score, 1) - pick(score, 2), 6).alias("margin"))


def best_with_gap(df: DataFrame, keys: list[str], score: str, text: str, gap: float) -> DataFrame:
    """The best of each key where nothing comes within the gap."""
    return best_two(df, keys, score, text).filter(F.col("margin").isNull() | (F.col("margin") >= gap))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the given columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def top_counts(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """keys, value, cnt: the k most frequent values of each key, ties by value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    w = Window.partitionBy(*keys).orderBy(F.desc("cnt"), value)
    return counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def at_ranks(df: DataFrame, keys: list[str], value: str, index: dict) -> DataFrame:
    """keys, n, and the values at indexes of each key's sorted values; index: name -> function of n that gives it, from 0.

    Values are counted first, in ranges of a key's span, and only ranges that hold a wanted place are looked into: no
    task sorts a whole key.
    """
    some = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    spans = some.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("cnt").alias("n"))
    width = (F.col("high") - F.col("low")) / 4096
    placed = some.join(spans, keys).withColumn("part", F.when(width > 0, F.least(F.floor((F.col(value) - F.col("low")) / width), F.lit(4095))).otherwise(0))
    ranges = placed.groupBy(*keys, "part").agg(F.sum("cnt").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("i")) for name, f in index.items()]))
    asked = ranges.withColumn("before", before).join(spans.select(*keys, "n", wanted.alias("w")), keys).filter("w.i >= before and w.i < before + size").select(*keys, "part", "before", "n", "w")
    held = placed.select(*keys, "part", value, "cnt").join(asked.select(*keys, "part").distinct(), [*keys, "part"])
    upto = held.withColumn("upto", F.sum("cnt").over(Window.partitionBy(*keys, "part").orderBy(value)))
    found = upto.join(asked, [*keys, "part"]).filter("w.i >= before + upto - cnt and w.i < before + upto")
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("w.name") == name, F.col(value))).alias(name) for name in index])


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """count, the value at rank ceil(n * q) for each share, and the largest."""
    index = {name: (lambda n, q=q: F.greatest(F.ceil(n * F.lit(q)) - 1, F.lit(0))) for name, q in shares.items()}
    return at_ranks(df, keys, value, index | {"largest": lambda n: n - 1})


def floor_rank(df: DataFrame, keys: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """count and the value at index floor((n - 1) * p / 100) of the sorted values."""
    return at_ranks(df, keys, value, {name: (lambda n, p=p: F.floor((n - 1) * p / 100)) for name, p in percents.items()})


def ordinal(df: DataFrame, keys: list[str], part, order: list, name: str) -> DataFrame:
    """df with each row's place from 1 within its keys: the rank within a range (part, in order) and the counts of the
    ranges before, so that no task holds a whole key."""
    ranged = df.withColumn("part_", part)
    sizes = ranged.groupBy(*keys, "part_").agg(F.count("*").alias("n_"))
    before = sizes.select(*keys, "part_", F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    inner = F.row_number().over(Window.partitionBy(*keys, "part_").orderBy(*order))
    return ranged.withColumn("r_", inner).join(before, [*keys, "part_"]).withColumn(name, F.col("r_") + F.col("before_")).drop("part_", "r_", "before_")


def context_frames(frames: DataFrame, most: int = 4) -> DataFrame:
    """lang, word, context, rn: the first distinct frames(doc_id, lang, pos, word, context) of each word."""
    found = frames.groupBy("lang", "word", "context").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    order = Window.partitionBy("lang", "word").orderBy("first")
    return found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).select("lang", "word", "context", "rn")


def within_margin(df: DataFrame, keys: list[str], score: str, margin: float) -> DataFrame:
    """The rows of each key whose score comes within the margin of its best."""
    return df.withColumn("lead_by", F.max(score).over(Window.partitionBy(*keys)) - F.col(score)).filter(F.col("lead_by") <= margin)


def lane_quota(df: DataFrame, keys: list[str], lane: str, order: list, quota: int, cap: int) -> DataFrame:
    """At most `quota` rows of each lane and `cap` in all for each key."""
    ranked = df.withColumn("in_lane", F.row_number().over(Window.partitionBy(*keys, lane).orderBy(*order))).filter(F.col("in_lane") <= quota)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("in_lane", *order))).filter(F.col("place") <= cap)
