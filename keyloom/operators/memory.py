"""What use leaves behind: counts of typed, accepted and rejected words, votes of episodes, sketches, layered packages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import surface as S

#: Distinct episodes that a word is remembered by.
VOTES = 3
SKETCH_LANES, SKETCH_WIDTH = 2, 1 << 16


def surfaces(accepted: DataFrame, typed: DataFrame) -> DataFrame:
    """word, score of accepted(word, cnt) words of 2 to 32 letters and hyphens: 4 * accepted + at most 50 of those typed."""
    fine = F.col("word").rlike(r"^[\p{L}-]+$") & F.length("word").between(2, 32)
    both = accepted.filter(fine & (F.col("cnt") >= 1)).join(typed.select("word", F.col("cnt").alias("typed")), "word", "left")
    return both.select("word", (F.col("cnt") * 4 + F.least(F.coalesce("typed", F.lit(0)), F.lit(50))).alias("score"))


def rejected_sources(df: DataFrame, proposal: str, accepted: str) -> DataFrame:
    """word, weight: how often a word of a proposal isn't among those that were accepted."""
    words = F.array_except(S.memory_words(F.coalesce(F.col(proposal), F.lit(""))), S.memory_words(F.coalesce(F.col(accepted), F.lit(""))))
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("weight"))


def promoted_counts(df: DataFrame, target: str, count: str, promoted: Column) -> DataFrame:
    """word, weight: by the last word of each target, its count and 3 more where it was promoted."""
    rows = df.select(F.element_at(F.concat(F.array(F.lit("")), S.memory_words(F.col(target))), -1).alias("word"), (F.col(count) + F.when(promoted, 3).otherwise(0)).alias("w"))
    return rows.filter("word != ''").groupBy("word").agg(F.sum("w").alias("weight"))


def episode_votes(df: DataFrame, keys: list[str], episode: str, most: int = VOTES) -> DataFrame:
    """keys, votes, episodes: the first distinct episodes of each key, at most `most`; merging such tables is the same again."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(episode))
    first = df.select(*keys, episode).distinct().withColumn("place", place).filter(F.col("place") <= most)
    return first.groupBy(*keys).agg(F.count("*").alias("votes"), F.array_sort(F.collect_list(episode)).alias("episodes"))


def histograms(df: DataFrame, values: dict[str, Column], k: int) -> DataFrame:
    """name, value, n, place: the k most frequent values of each of several columns, in one scan."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in values.items()])).alias("x")).select("x.*").filter("value is not null")
    counts = rows.groupBy("name", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))).filter(F.col("place") <= k)


def _lane(key: Column, lane: int) -> Column:
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1 + 4 * lane, 4), 16, 10).cast("long") % SKETCH_WIDTH


def sketch(df: DataFrame, key: Column, count: Column) -> DataFrame:
    """lane, cell, n: a count-min sketch of two lanes of 65,536 counters, each at most 65,535."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("lane"), _lane(key, k).alias("cell")) for k in range(SKETCH_LANES)]))
    rows = df.select(cells.alias("c"), count.alias("w")).select("c.*", "w")
    return rows.groupBy("lane", "cell").agg(F.least(F.sum("w"), F.lit(65_535)).alias("n"))


def estimates(df: DataFrame, key: Column, counters: DataFrame) -> DataFrame:
    """df with estimate, the least of a key's counters; the sketch has a fixed bound and is broadcast."""
    small = F.broadcast(counters)
    for lane in range(SKETCH_LANES):
        of_lane = small.filter(F.col("lane") == lane).select(F.col("cell").alias(f"cell_{lane}"), F.col("n").alias(f"n_{lane}"))
        df = df.withColumn(f"cell_{lane}", _lane(key, lane)).join(of_lane, f"cell_{lane}", "left").drop(f"cell_{lane}")
    return df.withColumn("estimate", F.least(*[F.coalesce(f"n_{lane}", F.lit(0)) for lane in range(SKETCH_LANES)])).drop(*[f"n_{lane}" for lane in range(SKETCH_LANES)])


# Packages of entries (keys, support, threshold) in layers


def merged(parts: list[DataFrame], keys: list[str], least: int = 1) -> DataFrame:
    """keys, support: the sum over shards of those with enough support; the order of shards doesn't matter."""
    return reduce(DataFrame.unionByName, [p.select(*keys, "support") for p in parts]).groupBy(*keys).agg(F.sum("support").alias("support")).filter(F.col("support") >= least)


def composed(base: DataFrame, deltas: list[DataFrame], keys: list[str], global_threshold: int) -> DataFrame:
    """keys, support, threshold: a base with its deltas; thresholds are the base's, or the global one for keys that it lacks."""
    every = merged([base, *deltas], keys)
    return every.join(base.select(*keys, "threshold"), keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(global_threshold)))


def without_tombstones(entries: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """The entries(keys, generation, ...) that no tombstone(keys, generation) of their generation or a later one deletes."""
    last = tombstones.groupBy(*keys).agg(F.max("generation").alias("deleted"))
    return entries.join(last, keys, "left").filter(F.col("deleted").isNull() | (F.col("deleted") < F.col("generation"))).drop("deleted")


def deltas(base: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """keys, base, live, delta of the counts (cnt) that differ."""
    both = base.select(*keys, F.col("cnt").alias("base")).join(live.select(*keys, F.col("cnt").alias("live")), keys, "full")
    out = both.select(*keys, F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("live", F.lit(0)).alias("live"))
    return out.withColumn("delta", F.col("live") - F.col("base")).filter("delta != 0")
