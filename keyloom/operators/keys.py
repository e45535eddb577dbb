"""Streams of keys as tables: words between spaces, scopes of taps, layouts, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import text as X


def key_events(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, ch: one row a character."""
    return df.select(*keys, F.posexplode(X.chars(F.coalesce(F.col(text), F.lit("")))).alias("pos", "ch"))


def event_words(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word_no, typed, opposite, n: the words that spaces (keys of their own) end, in both layouts.

    Characters come together again by their places, so the order of rows doesn't matter; a word's number is that of the
    spaces before it, counted once for each word.
    """
    from pyspark.sql import Window

    spaces = F.sum((F.col("ch") == " ").cast("int")).over(Window.partitionBy(*keys).orderBy("pos"))
    runs = events.withColumn("gap", spaces).filter("ch != ' '").groupBy(*keys, "gap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda s: s["ch"]), "").alias("typed"), F.count("*").alias("n"))
    return runs.withColumn("word_no", F.row_number().over(Window.partitionBy(*keys).orderBy("gap"))).withColumn("opposite", X.project(F.col("typed"))).drop("gap")


def tap_scope(taps: Column) -> Column:
    """How many words a burst of taps takes back: none below two, then 1, 2, and 3 at most."""
    return F.when(taps >= 2, F.least(taps - 1, F.lit(3)))


def overlap(a: Column, b: Column) -> Column:
    """The length of the longest end of a that b begins with."""
    n = F.least(F.length(a), F.length(b))
    lengths = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    found = F.filter(lengths, lambda k: F.substr(a, F.length(a) - k + 1, k) == F.substr(b, F.lit(1), k))
    return F.coalesce(F.array_max(found), F.lit(0))


def joined(a: Column, b: Column) -> Column:
    """b after a, without what both share at the seam."""
    return F.concat(a, F.substr(b, overlap(a, b) + 1))


def layout_corrections(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """tokens with replacement: words typed on the other layout that are known there and not as typed, by an equi-join
    on the projected word; punctuation around them stays, protected shapes are left alone."""
    edges = X.edge_punctuation(F.col(token))
    parts = tokens.withColumn("e", edges).withColumn("core", F.lower("e.core")).withColumn("other", F.lower(X.project(F.col("e.core"))))
    known = lexicon.select("word").distinct()
    found = parts.filter((F.length("core") >= 2) & ~X.is_technical(F.col("e.core"))).join(known.withColumnRenamed("word", "other"), "other", "left_semi").join(known.withColumnRenamed("word", "core"), "core", "left_anti")
    return found.withColumn("replacement", F.concat("e.lead", "other", "e.trail")).drop("e", "core", "other")


def segmentations(words: DataFrame, lexicon: DataFrame, shortest: int = 3) -> DataFrame:
    """lang, word, parts, n: words cut into two or three known ones; each step is a join on prefixes, then on rests."""
    known = lexicon.select("lang", "word")
    cut = words.select("lang", "word", F.explode(X.splits(F.col("word"))).alias("s")).select("lang", "word", "s.*").filter((F.length("left") >= shortest) & (F.length("right") >= shortest))
    headed = cut.join(known.withColumnRenamed("word", "left"), ["lang", "left"], "left_semi")
    two = headed.join(known.withColumnRenamed("word", "right"), ["lang", "right"], "left_semi").select("lang", "word", F.concat_ws(" ", "left", "right").alias("parts"), F.lit(2).alias("n"))
    rest = headed.filter(F.length("right") >= 2 * shortest).select("lang", "word", "left", F.explode(X.splits(F.col("right"))).alias("s")).select("lang", "word", "left", F.col("s.left").alias("mid"), F.col("s.right").alias("right"))
    rest = rest.filter((F.length("mid") >= shortest) & (F.length("right") >= shortest))
    three = rest.join(known.withColumnRenamed("word", "mid"), ["lang", "mid"], "left_semi").join(known.withColumnRenamed("word", "right"), ["lang", "right"], "left_semi")
    return two.unionByName(three.select("lang", "word", F.concat_ws(" ", "left", "mid", "right").alias("parts"), F.lit(3).alias("n")))
