"""Event journals into keyed memory: weights, back-off keys, roll-ups, promotion, priors, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_WORDS = 5
ANY = "*"


def backoff_keys(context: Column) -> Column:
    """Suffixes of a context array, of 1 to 5 words, joined by spaces."""
    n = F.least(F.lit(CONTEXT_WORDS), F.size(context))
    return F.transform(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(context, F.size(context) - k + 1, k), " "))


def wildcard_counts(df: DataFrame, source: str, operation: str, rest: list[str], weight) -> DataFrame:
    """source, operation, rest, weight: sums under (source, operation), (*, operation) and (*, *)."""
    keys = F.array(*[F.struct(s.alias(source), o.alias(operation)) for s, o in ((F.col(source), F.col(operation)), (F.lit(ANY), F.col(operation)), (F.lit(ANY), F.lit(ANY)))])
    base = df.groupBy(source, operation, *rest).agg(F.sum(weight).alias("w"))
    return base.select(F.explode(keys).alias("k"), *rest, "w").groupBy(f"k.{source}", f"k.{operation}", *rest).agg(F.sum("w").alias("weight"))


def weighted_counts(df: DataFrame, kind: str, weights: dict[str, int], *keys: str) -> DataFrame:
    """map_name, keys, cnt: one scan fills every counter; exact repeats of a row count once."""
    of = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    rows = df.dropDuplicates().filter(F.col(kind).isin(*weights))
    return rows.groupBy(F.col(kind).alias("map_name"), *keys).agg(F.sum(F.try_element_at(of, F.col(kind))).cast("long").alias("cnt"))


def promoted(df: DataFrame, source: str, target: str, ts: str, least: int = 2) -> DataFrame:
    """source, target, count, first_ts, last_ts, promoted: pairs seen often enough; of several targets of one source the
    earliest to be seen is promoted and blocks the others."""
    pairs = df.groupBy(source, target).agg(F.count("*").alias("count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    able = F.when(F.col("count") >= least, 1)
    first = F.row_number().over(Window.partitionBy(source).orderBy(F.col("able").isNull(), "first_ts", target))
    return pairs.withColumn("able", able).withColumn("promoted", (first == 1) & F.col("able").isNotNull()).drop("able")


def accepted_without_rejected(df: DataFrame, keys: list[str], accepted, rejected, weight, least: int) -> DataFrame:
    """keys, weight of accepted rows of at least `least`, less the keys that were ever rejected."""
    return df.filter(accepted).groupBy(*keys).agg(F.sum(weight).alias("weight")).filter(F.col("weight") >= least).join(df.filter(rejected).select(*keys).distinct(), keys, "left_anti")


def prior_from_count(c):
    """clamp(ln(count + 1) * 0.036, 0, 0.22)."""
    return F.least(F.greatest(F.log(c + 1) * 0.036, F.lit(0.0)), F.lit(0.22))


def backoff_prior(counts: DataFrame, key: str, length: str, base: float) -> DataFrame:
    """word, prior: sum over context lengths of min(ln(count + 1) * (base + 0.01 n), 0.18), at most 0.34."""
    part = F.least(F.log(F.col("cnt") + 1) * (base + F.col(length) * 0.01), F.lit(0.18))
    return counts.groupBy(key).agg(F.least(F.sum(part), F.lit(0.34)).alias("prior"))


def signed_signal(accepted, rejected):
    """struct(posterior, confidence, weight): Laplace posterior, n / (n + 4), and their signed product."""
    n = accepted + rejected
    posterior, confidence = (accepted + 1) / (n + 2), n / (n + 4)
    return F.struct(posterior.alias("posterior"), confidence.alias("confidence"), ((posterior * 2 - 1) * confidence).alias("weight"))


def merged_counts(*maps: DataFrame) -> DataFrame:
    """key, cnt: the sum of count tables(key, cnt)."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return out.groupBy("key").agg(F.sum("cnt").alias("cnt"))


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows of keys with contradictory values."""
    bad = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo != hi").select(*keys)
    return df.join(bad, keys, "left_semi")


def kept_tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows: a top-k, never a sort of everything."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def byte_tail(df: DataFrame, keys: list[str], order: str, line: str, most: int) -> DataFrame:
    """The last lines of each key whose bytes, line feeds included, begin below the limit."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("after", F.coalesce(F.sum(F.octet_length(line) + 1).over(w), F.lit(0))).filter(F.col("after") < most)


def without_adjacent_repeats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that differ from the one before them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).filter(~F.col("before").eqNullSafe(F.col(value))).drop("before")


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """keys, n, ema: an exponential moving average in order of arrival, as a sum of weights by rank from the last; the
    first value has what remains. No array holds a key's rows."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])) - 1
    sized = df.withColumn("back", back).join(df.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    weight = F.pow(F.lit(1.0 - alpha), F.col("back")) * F.when(F.col("back") == F.col("n") - 1, 1.0).otherwise(alpha)
    return sized.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(weight * F.col(value).cast("double")).alias("ema"))
