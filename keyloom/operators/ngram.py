"""Character trigram model: counts, add-one scores, margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import text as X


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, lang, pos, word of every token of docs(doc_id, text, lang)."""
    return docs.select("doc_id", "lang", F.posexplode(X.words(F.col("text"))).alias("pos", "word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """lang, word, cnt: distinct tokens with their frequency."""
    return tokens(docs).groupBy("lang", "word").agg(F.count("*").alias("cnt"))


def train(words: DataFrame) -> DataFrame:
    """lang, gram, cnt over words(lang, word): each row of words counts once."""
    return words.select("lang", F.explode(X.trigrams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("cnt"))


def totals(model: DataFrame) -> DataFrame:
    """lang, total, vocab: one row a language."""
    return model.groupBy("lang").agg(F.sum("cnt").alias("total"), F.count("*").alias("vocab"))


def score(words: DataFrame, model: DataFrame) -> DataFrame:
    """words(lang, word) with score: the sum of ln((count + 1) / (total + vocab)) over trigrams."""
    grams = words.select("lang", "word", F.explode(X.trigrams(F.col("word"))).alias("gram"))
    seen = grams.join(model, ["lang", "gram"], "left").join(F.broadcast(totals(model)), "lang")
    return seen.groupBy("lang", "word").agg(F.sum(F.log((F.coalesce("cnt", F.lit(0)) + 1) / (F.col("total") + F.col("vocab")))).alias("score"))


def margins(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """pairs(lang, word, candidate) with margin: the candidate's score less the word's."""
    both = pairs.select("lang", "word").union(pairs.select("lang", "candidate")).distinct()
    scored = score(both, model)
    return pairs.join(scored, ["lang", "word"]).join(scored.select("lang", F.col("word").alias("candidate"), F.col("score").alias("other")), ["lang", "candidate"]).select("lang", "word", "candidate", (F.col("other") - F.col("score")).alias("margin"))


def language_delta(margin):
    return F.least(F.greatest(margin, F.lit(-4.0)), F.lit(8.0)) * 0.35
