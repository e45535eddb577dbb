"""Candidate generation: expansions joined with a lexicon, never word against word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import text as X


def lookup(words: DataFrame, lexicon: DataFrame, expand) -> DataFrame:
    """lang, word, candidate: expansions of words(lang, word) that lexicon(lang, word) knows."""
    found = words.select("lang", "word", F.explode(expand(F.col("word"))).alias("candidate"))
    return found.join(lexicon.select("lang", F.col("word").alias("candidate")), ["lang", "candidate"], "left_semi").filter("word != candidate").select("lang", "word", "candidate").distinct()


def unique_only(found: DataFrame) -> DataFrame:
    """Words with exactly one candidate."""
    return found.groupBy("lang", "word").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate")).filter("n = 1").drop("n")


def transpositions(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    return lookup(words, lexicon, X.adjacent_swaps)


def missing_letters(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One letter of the word left out: the lexicon's one-deletions meet the word, which no alphabet is needed for."""
    shorter = lexicon.select("lang", F.col("word").alias("candidate"), F.explode(X.one_deletions(F.col("word"))).alias("word")).filter("word != candidate")
    return words.select("lang", "word").join(shorter, ["lang", "word"]).select("lang", "word", "candidate").distinct()


def extra_letters(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    return lookup(words, lexicon, X.one_deletions)


def repeated_letters(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    return lookup(words, lexicon, X.repeated_run_deletions)


def class_substitutions(words: DataFrame, lexicon: DataFrame, classes: dict[str, str]) -> DataFrame:
    return lookup(words, lexicon, lambda w: X.substitutions(w, classes))


def neighbours(left: DataFrame, right: DataFrame) -> DataFrame:
    """lang, word, candidate within one edit (insertion, deletion, substitution, exchange of neighbours).

    An equi-join of deletion keys, then verification; levenshtein alone would be a join of all with all.
    """
    keys = lambda df, name: df.select("lang", F.col("word").alias(name)).withColumn("key", F.explode(X.one_deletions(F.col(name))))
    met = keys(left, "word").join(keys(right, "candidate"), ["lang", "key"]).filter("word != candidate").select("lang", "word", "candidate").distinct()
    return met.filter((F.levenshtein("word", "candidate", 1) >= 0) | X.is_adjacent_transposition(F.col("word"), F.col("candidate")))


def completions(prefixes: DataFrame, lexicon: DataFrame, k: int, shortest: int = 2, longest: int = 8) -> DataFrame:
    """lang, prefix, candidate, cnt, rank: the k most frequent words that go on from each prefix (equi-join on prefixes)."""
    lengths = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length("word") - 1))
    keyed = lexicon.filter(F.length("word") > shortest).select("lang", F.col("word").alias("candidate"), "cnt", F.explode(F.transform(lengths, lambda n: F.substr(F.col("word"), F.lit(1), n))).alias("prefix"))
    rank = F.row_number().over(Window.partitionBy("lang", "prefix").orderBy(F.desc("cnt"), "candidate"))
    return prefixes.select("lang", "prefix").distinct().join(keyed, ["lang", "prefix"]).withColumn("rank", rank).filter(F.col("rank") <= k)


def glued(words: DataFrame, lexicon: DataFrame, shortest: int = 3) -> DataFrame:
    """lang, word, left, right: words that are two known words run together."""
    cut = words.select("lang", "word", F.explode(X.splits(F.col("word"))).alias("s")).select("lang", "word", "s.*").filter((F.length("left") >= shortest) & (F.length("right") >= shortest))
    known = lexicon.select("lang", "word")
    return cut.join(known.withColumnRenamed("word", "left"), ["lang", "left"], "left_semi").join(known.withColumnRenamed("word", "right"), ["lang", "right"], "left_semi").select("lang", "word", "left", "right")


def split_pairs(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """lang, first, second, merged, n: neighbouring tokens(lang, first, second) whose concatenation is known."""
    counted = pairs.groupBy("lang", "first", "second").agg(F.count("*").alias("n")).withColumn("merged", F.concat("first", "second"))
    return counted.join(lexicon.select("lang", F.col("word").alias("merged")), ["lang", "merged"], "left_semi").select("lang", "first", "second", "merged", "n")


def moved_letter(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Neighbouring tokens(lang, first, second) of which the first's last letter belongs to the second: both repaired words are known."""
    some = pairs.filter("length(first) >= 3").select("lang", "first", "second").distinct()
    some = some.withColumn("left", F.expr("left(first, length(first) - 1)")).withColumn("right", F.expr("concat(right(first, 1), second)"))
    known = lexicon.select("lang", "word")
    return some.join(known.withColumnRenamed("word", "left"), ["lang", "left"], "left_semi").join(known.withColumnRenamed("word", "right"), ["lang", "right"], "left_semi").select("lang", "first", "second", "left", "right")
