"""Corpus building: corruptions, distractors, splits, weighted lexicons, set operations, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import text as X


def corruption(word: Column, pick: Column) -> Column:
    """struct(operation, damaged): one of five damages, chosen and placed by a whole number."""
    n, at = F.length(word), F.pmod(pick, F.greatest(F.length(word) - 1, F.lit(1))) + 1
    head, tail = F.substr(word, F.lit(1), at - 1), F.substr(word, at + 1)
    one, two = F.substr(word, at, F.lit(1)), F.substr(word, at + 1, F.lit(1))
    ways = {
        "omission": F.concat(head, tail),
        "repeat": F.concat(head, one, one, tail),
        "swap": F.concat(head, two, one, F.substr(word, at + 2)),
        "layout": X.to_russian(word),
        "split": F.concat(head, one, F.lit(" "), tail),
    }
    which = F.pmod(F.floor(pick / 7), F.lit(len(ways)))
    name = reduce(lambda acc, k: acc.when(which == k, list(ways)[k]), range(1, len(ways)), F.when(which == 0, list(ways)[0]))
    made = reduce(lambda acc, k: acc.when(which == k, list(ways.values())[k]), range(1, len(ways)), F.when(which == 0, list(ways.values())[0]))
    return F.struct(F.when(n >= 2, name).alias("operation"), F.when(n >= 2, made).alias("damaged"))


def stable_number(c: Column) -> Column:
    """A whole number from the first 28 bits of a text's SHA-256: the same on every engine."""
    return F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 7), 16, 10).cast("long")


def held_out(c: Column, below: int = 26) -> Column:
    """Whether the first byte of the SHA-256 lies below a bound: a tenth of all keys for 26."""
    return F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 2), 16, 10).cast("long") < below


def cyclic_distractors(words: DataFrame) -> DataFrame:
    """words(lang, word) with distractor: the next word of equal length and first letter, in a circle; else null."""
    bucket = Window.partitionBy("lang", F.length("word"), F.substring("word", 1, 1))
    after = F.lead("word").over(bucket.orderBy("word"))
    first = F.min("word").over(bucket)
    found = words.withColumn("distractor", F.coalesce(after, first))
    return found.withColumn("distractor", F.when(F.col("distractor") != F.col("word"), F.col("distractor")))


def repetitions(cnt: Column) -> Column:
    """1 + min(7, floor(log2(count)))."""
    return F.lit(1) + F.least(F.lit(7), F.length(F.bin(cnt)) - 1)


def weighted_lexicon(counts: DataFrame) -> DataFrame:
    """counts(lang, word, cnt) repeated by weight, with copy from 1."""
    return counts.select("lang", "word", F.explode(F.sequence(F.lit(1), repetitions(F.col("cnt")))).alias("copy"))


def first_source_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """key, source, n: each key with the first source that has it, and in how many sources it is."""
    tagged = reduce(DataFrame.unionByName, [s.select(F.col(key), F.lit(k).alias("source")).distinct() for k, s in enumerate(sources)])
    return tagged.groupBy(key).agg(F.min("source").alias("source"), F.count("*").alias("n"))


def multiset_difference(base: DataFrame, current: DataFrame) -> DataFrame:
    """side, columns, n: rows that one side has more often than the other (counted, not expanded)."""
    keys = base.columns
    both = base.withColumn("sign", F.lit(-1)).unionByName(current.select(keys).withColumn("sign", F.lit(1)))
    return both.groupBy(*keys).agg(F.sum("sign").alias("n")).filter("n != 0").select(F.when(F.col("n") > 0, "current").otherwise("base").alias("side"), *keys, F.abs("n").alias("n"))


def zip_longest(left: DataFrame, right: DataFrame, ordinal: str, value: str) -> DataFrame:
    """ordinal, side, value in turns: left and right of each ordinal, the longer side going on alone."""
    return left.select(ordinal, F.lit(0).alias("side"), value).unionByName(right.select(ordinal, F.lit(1).alias("side"), value))


def next_tokens(pairs: DataFrame, least: int = 1) -> DataFrame:
    """lang, word, successor, support: how often each token follows another; pairs(lang, first, second)."""
    counted = pairs.groupBy("lang", F.col("first").alias("word"), F.col("second").alias("successor")).agg(F.count("*").alias("support"))
    return counted.filter(F.col("support") >= least)


def next_token_top1(pairs: DataFrame) -> DataFrame:
    """lang, word, successor, support: the likeliest successor of each token, ties to the smaller."""
    w = Window.partitionBy("lang", "word").orderBy(F.desc("support"), "successor")
    return next_tokens(pairs).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def presence_features(words: DataFrame) -> DataFrame:
    """lang, feature, n: in how many words(lang, word) each 2-4-gram, marked edge of 1-5 letters or whole word up to 5 occurs."""
    w, size = F.col("word"), F.length("word")
    none = F.array().cast("array<string>")
    grams = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))).otherwise(none)
    edges = F.sequence(F.lit(1), F.least(size, F.lit(5)))
    heads = F.transform(edges, lambda n: F.concat(F.lit("^"), F.substr(w, F.lit(1), n)))
    tails = F.transform(edges, lambda n: F.concat(F.substr(w, size - n + 1, n), F.lit("$")))
    whole = F.when(size <= 5, F.array(F.concat(F.lit("^"), w, F.lit("$")))).otherwise(none)
    features = F.array_distinct(F.concat(grams(2), grams(3), grams(4), heads, tails, whole))
    return words.filter(size > 0).select("lang", F.explode(features).alias("feature")).groupBy("lang", "feature").agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, keys: list[str], right: Column) -> DataFrame:
    """keys, total, ok, accuracy."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(right).alias("ok"), F.round(F.count_if(right) / F.count("*"), 6).alias("accuracy"))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, f1: one scan; each row counts under every threshold by a bounded explode."""
    hit = F.col(score) >= F.col("threshold")
    rows = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    out = rows.groupBy("threshold").agg(F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & (F.col(label) == 1)).alias("fn"))
    return out.withColumn("f1", F.round(F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0), 6))


def damaged_letters(word: Column, seed: Column, letters: tuple[str, str, str, str] = ("а", "о", "е", "и")) -> dict[str, Column]:
    """Four kinds of damage to words of five letters or more, placed by a seed: a letter more, another letter, the end
    missing, two neighbours exchanged with another letter after them."""
    a, o, e, i = letters
    n = F.length(word)
    at = (seed % (n - 2) + 1).cast("int")
    other = lambda c, x, y: F.when(c == x, y).otherwise(x)
    ch = lambda w, k: F.substr(w, k + 1, F.lit(1))
    first = (seed % (n - 3) + 1).cast("int")
    swapped = F.concat(F.substr(word, F.lit(1), first), ch(word, first + 1), ch(word, first), F.substr(word, first + 3))
    second = F.least(first + 2, n - 2)
    return {
        "extra": F.concat(F.substr(word, F.lit(1), at), other(ch(word, at), a, o), F.substr(word, at + 1)),
        "substitution": F.concat(F.substr(word, F.lit(1), at), other(ch(word, at), a, o), F.substr(word, at + 2)),
        "completion": F.substr(word, F.lit(1), (n - 2 - seed % 2).cast("int")),
        "composite": F.concat(F.substr(swapped, F.lit(1), second), other(ch(swapped, second), e, i), F.substr(swapped, second + 2)),
    }


def fragment_scores(words: DataFrame, features: DataFrame, id_: str = "word") -> DataFrame:
    """id, lang, total: of every side, the summed weights of all overlapping 2-4-grams of ^word$ (each occurrence counts);
    features(lang, feature, n). Sides without a known feature don't come back."""
    w = F.concat(F.lit("^"), F.col(id_), F.lit("$"))
    grams = F.flatten(F.transform(F.array(*map(F.lit, (2, 3, 4))), lambda n: F.transform(F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(w, i, n))))
    rows = words.select(id_, F.explode(grams).alias("feature")).groupBy(id_, "feature").agg(F.count("*").alias("times"))
    return rows.join(features, "feature").groupBy(id_, "lang").agg(F.sum(F.col("times") * F.col("n")).alias("total"))


def cycled_lines(words: DataFrame, lines: int, width: int = 12) -> DataFrame:
    """lang, line, text: words(lang, word, i, size), i from 1 in order of word, taken in turns, `width` a line."""
    slots = F.explode(F.sequence(F.col("i") - 1, F.lit(lines * width - 1).cast("long"), F.col("size")))
    some = words.filter(F.col("i") <= lines * width).select("lang", "word", slots.alias("slot")).withColumn("line", F.floor(F.col("slot") / width))
    return some.groupBy("lang", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "word"))), lambda s: s["word"]), " ").alias("text"))
