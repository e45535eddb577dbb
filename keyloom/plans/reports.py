"""Reports over nested journals, and rules on texts; they join the other queries on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import surface as S
from keyloom.operators import rank
from keyloom.plans.queries import _RU, _US, _TOK, _vocabulary, query, read
from keyloom.sources import text as sources

_GATE = "ts BIGINT, kind STRING, reason STRING, output_ms BIGINT, input_gate STRUCT<candidate_count: BIGINT, selected_source: STRING, candidate_scores: ARRAY<STRUCT<selected: BOOLEAN, moved: BOOLEAN, verified: BOOLEAN, score: DOUBLE>>>"
_RECORDS = """r AS (SELECT event_id AS ts, CASE event_type WHEN 'click' THEN 'candidate_before_apply' WHEN 'error' THEN 'ibus_committed_tail_replace_guard' ELSE 'replacement' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'stale_tail' ELSE 'other' END AS reason, event_id % 400 AS output_ms, event_id % 5 AS candidate_count, CASE event_id % 3 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'nanda' ELSE 'learned' END AS source,
event_id % 4 AS chosen, event_id % 6 = 0 AS moved, event_id % 12 <> 0 AS verified FROM events)"""


def _gates(spark, d):
    """Records with a nested gate, written as JSON lines and read back by their schema."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "candidate_before_apply").when(F.col("event_type") == "error", "ibus_committed_tail_replace_guard").otherwise("replacement")
    scores = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct((k == i % 4).alias("selected"), (i % 6 == 0).alias("moved"), (i % 12 != 0).alias("verified"), (k / 2.0 + (i % 2)).alias("score")))
    gate = F.struct((i % 5).alias("candidate_count"), F.when(i % 3 == 0, "deterministic").when(i % 3 == 1, "nanda").otherwise("learned").alias("selected_source"), scores.alias("candidate_scores"))
    rows = read(spark, d, "events").select(i.alias("ts"), kind.alias("kind"), F.when(i % 3 == 0, "stale_tail").otherwise("other").alias("reason"), (i % 400).alias("output_ms"), gate.alias("input_gate"))
    path = sources.shared_path(spark, "gates")
    sources.append_journal(rows, path)
    return sources.journal(spark, path, _GATE)


@query(f"WITH {_RECORDS} SELECT count(*) AS records, sum(candidate_count)::BIGINT AS candidates, sum(candidate_count)::BIGINT // count(*) AS mean, count(*) FILTER (candidate_count = 0) AS none, count(*) FILTER (source = 'nanda') AS nanda, count(*) FILTER (source = 'deterministic') AS deterministic, max(output_ms) AS slowest, count(*) FILTER (output_ms >= 250) AS slow, count(*) FILTER (kind = 'ibus_committed_tail_replace_guard' AND reason LIKE '%stale%') AS stale FROM r")
def gate_report(spark, d):
    """One scan, every counter: totals, integer means, sources, slow and stale records."""
    g = F.col("input_gate")
    stale = (F.col("kind") == "ibus_committed_tail_replace_guard") & F.col("reason").contains("stale")
    found = _gates(spark, d).agg(F.count("*").alias("records"), F.sum(g["candidate_count"]).alias("candidates"), F.count_if(g["candidate_count"] == 0).alias("none"), F.count_if(g["selected_source"] == "nanda").alias("nanda"), F.count_if(g["selected_source"] == "deterministic").alias("deterministic"), F.max("output_ms").alias("slowest"), F.count_if(F.col("output_ms") >= 250).alias("slow"), F.count_if(stale).alias("stale"))
    return found.withColumn("mean", F.expr("candidates div records"))


@query(f"WITH {_RECORDS}, s AS (SELECT *, chosen < 3 AS has FROM r) SELECT ts, CASE WHEN has AND moved AND NOT verified THEN 'selected_left_context_changed,selected_unverified_transition' WHEN has AND moved THEN 'selected_left_context_changed' ELSE '' END AS reasons, has AND chosen < 2 AS not_top FROM s WHERE kind = 'candidate_before_apply'")
def selected_candidate_reasons(spark, d):
    """What the selected element of a nested array says, and whether another scored higher."""
    picked = F.get(F.filter("input_gate.candidate_scores", lambda c: c["selected"]), F.lit(0))
    rows = _gates(spark, d).filter("kind = 'candidate_before_apply'").withColumn("s", picked)
    moved = F.coalesce(F.col("s.moved"), F.lit(False))
    reasons = F.array_compact(F.array(F.when(moved, "selected_left_context_changed"), F.when(moved & ~F.coalesce(F.col("s.verified"), F.lit(True)), "selected_unverified_transition")))
    top = F.array_max(F.transform("input_gate.candidate_scores", lambda c: c["score"]))
    return rows.select("ts", F.array_join(reasons, ",").alias("reasons"), F.coalesce(F.col("s.score") < top, F.lit(False)).alias("not_top"))


@query(f"WITH {_RECORDS}, n AS (SELECT source, output_ms, row_number() OVER (PARTITION BY source ORDER BY output_ms) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM r) SELECT source, max(n) AS n, round(avg(output_ms), 6) AS mean, max(CASE WHEN i = (n - 1) * 50 // 100 THEN output_ms END) AS p50, max(CASE WHEN i = (n - 1) * 99 // 100 THEN output_ms END) AS p99 FROM n GROUP BY source")
def gate_latencies(spark, d):
    rows = _gates(spark, d).select(F.col("input_gate.selected_source").alias("source"), "output_ms")
    means = rows.groupBy("source").agg(F.round(F.avg("output_ms"), 6).alias("mean"))
    return rank.floor_rank(rows, ["source"], "output_ms", {"p50": 50, "p99": 99}).join(means, "source").select("source", "n", "mean", "p50", "p99")


_PHRASES = r"f AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\n.!?;]')) AS phrase FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, trim(regexp_replace(phrase, '[\t-\r\x{85}\p{Z}]+', ' ', 'g')) AS t FROM f)"


@query(rf"""WITH {_PHRASES} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN t = '' OR contains(t, '://') OR contains(t, '@') OR contains(t, '=') OR regexp_matches(t, '[\x00-\x1f\x7f]') OR regexp_matches(t, '^[!-/:-@\[-`{{-~…]') OR regexp_matches(t, '(^| )-[^ ]') THEN 'unsafe_text' WHEN 2 * length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) < greatest(length(regexp_replace(t, ' ', '', 'g')), 1) THEN 'low_language_quality' ELSE 'accepted' END AS reason FROM t) GROUP BY reason""")
def phrase_ingest(spark, d):
    """Phrases between sentence ends, kept or counted by the reason against them."""
    phrases = read(spark, d, "documents").filter("text is not null").select(F.explode(F.split("text", r"[\n.!?;]")).alias("phrase"))
    return phrases.groupBy(F.coalesce(S.reject_reason(F.col("phrase")), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


_RUSSIAN = f"w AS (SELECT DISTINCT translate(word, '{_US}', '{_RU}') AS w FROM voc WHERE regexp_matches(word, '^[a-z]{{4,}}$') AND NOT regexp_matches(translate(word, '{_US}', '{_RU}'), '[^а-яё]'))"


def _russian(spark, d):
    from keyloom.functions import text as X

    w = X.to_russian(F.col("word"))
    return _vocabulary(spark, d).filter("word rlike '^[a-z]{4,}$'").select(w.alias("w")).filter("not w rlike '[^а-яё]'").distinct()


@query(f"WITH {_TOK}, {_RUSSIAN}, v AS (SELECT w, upper(left(w, 1)) || substr(w, 2, 1) || upper(substr(w, 3)) AS odd, substr(w, 1, 2) || upper(substr(w, 3)) AS low FROM w) SELECT w, odd, upper(left(w, 1)) || substr(w, 2) AS fixed, low, w AS lowered FROM v")
def mixed_cases(spark, d):
    odd, low = F.expr("upper(left(w, 1)) || substr(w, 2, 1) || upper(substr(w, 3))"), F.expr("substr(w, 1, 2) || upper(substr(w, 3))")
    rows = _russian(spark, d).select("w", odd.alias("odd"), low.alias("low"))
    return rows.select("w", "odd", S.mixed_case(F.col("odd")).alias("fixed"), "low", S.mixed_case(F.col("low")).alias("lowered"))


@query(f"WITH {_TOK}, x AS (SELECT DISTINCT word, length(regexp_replace(word, '[^\\p{{L}}]', '', 'g')) AS n FROM voc WHERE length(word) >= 3), p AS (SELECT word, n, left(word, 3) AS target, length(regexp_replace(left(word, 3), '[^\\p{{L}}]', '', 'g')) AS m FROM x) SELECT word, target, word <> target AND NOT (m + 1 < n OR m <= 3) AS unknown, word <> target AS known, true AS phrase FROM p")
def safe_replacements(spark, d):
    words = _vocabulary(spark, d).filter("length(word) >= 3").select("word").distinct().withColumn("target", F.substring("word", 1, 3))
    a, b = F.col("word"), F.col("target")
    return words.select("word", "target", S.safe_replacement(a, b, F.lit(False)).alias("unknown"), S.safe_replacement(a, b, F.lit(True)).alias("known"), S.safe_replacement(F.concat(a, F.lit(" x")), b, F.lit(False)).alias("phrase"))


@query(f"WITH {_TOK}, p AS (SELECT DISTINCT word FROM voc WHERE length(word) >= 4 AND NOT contains(word, '-')) SELECT word, substr(word, 1, 2) || ' ' || substr(word, 3) AS a, substr(word, 1, 3) || ' ' || substr(word, 4) AS b, true AS shifted, false AS same FROM p")
def boundary_shifts(spark, d):
    words = _vocabulary(spark, d).filter("length(word) >= 4 and not contains(word, '-')").select("word").distinct()
    rows = words.select("word", F.expr("substr(word, 1, 2) || ' ' || substr(word, 3)").alias("a"), F.expr("substr(word, 1, 3) || ' ' || substr(word, 4)").alias("b"))
    return rows.select("word", "a", "b", S.boundary_shifted(F.col("a"), F.col("b")).alias("shifted"), S.boundary_shifted(F.col("a"), F.col("a")).alias("same"))


@query(rf"""WITH t AS (SELECT conv_id, turn, lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS text FROM conversations WHERE text IS NOT NULL), x AS (SELECT *, list_filter(string_split(text, ' '), lambda v: v <> '') AS w FROM t) SELECT conv_id, turn, CASE WHEN len(w) >= 2 THEN regexp_replace(text, '([a-z]+)( +[a-z]+ *)\z', 'word\2') END AS replaced, false AS russian FROM x WHERE NOT regexp_matches(text, '(^| )word +[a-z]+ *\z')""")
def words_before_last(spark, d):
    texts = read(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")).alias("text"))
    rows = texts.filter("not text rlike '(^| )word +[a-z]+ *$'")
    return rows.select("conv_id", "turn", S.replace_word_before_last(F.col("text"), F.lit("word")).alias("replaced"), S.preferred_russian(F.col("text"), F.lit(False)).alias("russian"))
