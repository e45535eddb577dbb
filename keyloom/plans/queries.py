"""Registered queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import distance, text as X
from keyloom.operators import candidates, contexts, corpus, decide, journal, ngram, rank
from keyloom.sources import text as sources
from keyloom.streaming import batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_US, _RU = X.US.replace("'", "''"), X.RU.replace("'", "''")
# DuckDB's distance counts bytes: letters beyond ASCII become single, otherwise unused ones.
_WIDE, _BYTE = "àâäáãéèêëíîïìóôöòõúûüùçñßœæÿý", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123"[:29]
_TOK = r"""
t AS (SELECT doc_id, lang, regexp_split_to_array(lower(text), '[^\p{L}-]+') AS a FROM documents),
u AS (SELECT doc_id, lang, list_filter(a, lambda x: length(x) BETWEEN 2 AND 24) AS a FROM t),
tok AS (SELECT doc_id, lang, unnest(a) AS word, unnest(range(len(a))) AS pos FROM u),
voc AS (SELECT lang, word, count(*) AS cnt FROM tok GROUP BY ALL)"""
_GRAM = r"""
gr AS (SELECT lang, word, unnest(list_transform(range(1, length(word) + 2), lambda i: substr('^^' || word || '$', i, 3))) AS gram FROM {words}),
model AS (SELECT lang, gram, count(*) AS cnt FROM (SELECT lang, word, unnest(list_transform(range(1, length(word) + 2), lambda i: substr('^^' || word || '$', i, 3))) AS gram FROM voc) GROUP BY ALL),
tot AS (SELECT lang, sum(cnt) AS total, count(*) AS vocab FROM model GROUP BY lang)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(spark, d):
    return ngram.tokens(read(spark, d, "documents"))


def _vocabulary(spark, d):
    return ngram.vocabulary(read(spark, d, "documents"))


def _common(spark, d):
    """The frequent words stand in for a lexicon."""
    return _vocabulary(spark, d).filter("cnt >= 5")


_COMMON = _TOK + ", lex AS (SELECT * FROM voc WHERE cnt >= 5), rare AS (SELECT * FROM voc WHERE cnt < 5)"

# Text


@query(f"SELECT doc_id, translate(text, '{_US}', '{_RU}') AS shown, translate(translate(text, '{_US}', '{_RU}'), '{_RU}', '{_US}') AS back FROM documents")
def layout_projection(spark, d):
    shown = X.to_russian(F.col("text"))
    return read(spark, d, "documents").select("doc_id", shown.alias("shown"), X.to_english(shown).alias("back"))


@query(r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^а-яА-ЯёЁ]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'ru2us' ELSE 'us2ru' END AS direction,
 length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM documents""")
def detect_direction(spark, d):
    return read(spark, d, "documents").select("doc_id", X.direction(F.col("text")).alias("direction"), X.count_of(F.col("text"), "[A-Za-z]").cast("long").alias("latin"))


@query(rf"""WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[\s]+', ' ', 'g'), ' ')) AS token FROM documents),
x AS (SELECT token, regexp_replace(regexp_replace(token, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '') AS core FROM w),
s AS (SELECT token, core, regexp_matches(core, '[а-яА-ЯёЁ]') AS cyr, regexp_matches(core, '[A-Za-z]') AS lat, regexp_matches(core, '[0-9]') AS dig,
 regexp_matches(core, '[^а-яА-ЯёЁA-Za-z0-9\-_./\\:@''+#]') AS oth, regexp_replace(core, '[^A-Za-z]', '', 'g') AS al FROM x),
k AS (SELECT *, CASE WHEN core = '' THEN 'empty' WHEN oth OR (NOT cyr AND NOT lat AND NOT dig) THEN 'other' WHEN cyr::INT + lat::INT + dig::INT > 1 THEN 'mixed' WHEN cyr THEN 'cyrillic' WHEN lat THEN 'ascii' ELSE 'numeric' END AS script,
 contains(core, '://') OR contains(core, '@') OR dig OR (NOT regexp_matches(core, '[^\x00-\x7F]') AND lat AND (regexp_matches(core, '[A-Za-z][^A-Za-z]*[A-Za-z].*\.[A-Za-z]{{2,4}}$') OR regexp_matches(core, '[A-Za-z0-9][-_][A-Za-z0-9]') OR regexp_matches(core, '[/\\@+#]') OR regexp_matches(al, '^[A-Z]{{2,4}}$') OR (length(al) >= 4 AND regexp_matches(al, '[a-z]') AND regexp_matches(al, '^.+[A-Z]')))) AS tech FROM s)
SELECT token, core, script, CASE WHEN core = '' THEN 'empty' WHEN regexp_matches(core, '^--?[A-Za-z0-9_=./:,\-]*[A-Za-z][A-Za-z0-9_=./:,\-]*$') THEN 'cli_option' WHEN tech THEN 'technical' WHEN script = 'mixed' THEN 'mixed_script' WHEN script = 'numeric' THEN 'number' WHEN script IN ('cyrillic', 'ascii') THEN 'plain_word' ELSE 'other' END AS kind FROM k""")
def token_identity(spark, d):
    tokens = read(spark, d, "documents").select(F.explode(F.split(F.regexp_replace("text", r"[\s]+", " "), " ")).alias("token")).distinct()
    core = tokens.withColumn("core", F.regexp_replace(F.regexp_replace("token", r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", ""))
    return core.select("token", "core", X.script(F.col("core")).alias("script"), X.kind(F.col("core")).alias("kind"))


@query(f"WITH {_TOK} SELECT lang, count(*) AS tokens, count(DISTINCT word) AS words, max(length(word)) AS longest FROM tok GROUP BY lang")
def tokens_by_lang(spark, d):
    return _tokens(spark, d).groupBy("lang").agg(F.count("*").alias("tokens"), F.countDistinct("word").alias("words"), F.max(F.length("word")).cast("long").alias("longest"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}]+'), lambda x: x <> '') AS a FROM documents),
p AS (SELECT doc_id, len(a) AS words, len(list_filter(a, lambda x: length(x) <= 2 OR (length(regexp_replace(x, '[^aeiouAEIOU]', '', 'g')) >= greatest(ceil(length(x) / 5), 1) AND NOT regexp_matches(regexp_replace(x, '[aeiouAEIOU]', ' ', 'g'), '[^ ]{4}')))) AS ok FROM w)
SELECT doc_id, words, CASE WHEN words = 0 THEN 1.0 ELSE round(ok / words, 6) END AS score FROM p""")
def plausibility_score(spark, d):
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "")
    return read(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.round(X.plausibility(F.col("text")), 6).alias("score"))


@query(r"""SELECT doc_id, list_extract(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> ''), -1) AS last_word, len(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> '')) AS n FROM documents""")
def text_words(spark, d):
    return read(spark, d, "documents").select("doc_id", X.last_word(F.col("text")).alias("last_word"), F.size(X.normalized_words(F.col("text"))).cast("long").alias("n"))


# Trigram model


@query(f"WITH {_TOK}, {_GRAM.format(words='voc')} SELECT lang, gram, cnt FROM model")
def ngram_counts(spark, d):
    return ngram.train(_vocabulary(spark, d))


@query(f"""WITH {_TOK}, {_GRAM.format(words='voc')}, sc AS (SELECT gr.lang, word, round(sum(ln((model.cnt + 1) / (total + vocab))), 6) AS score FROM gr JOIN model USING (lang, gram) JOIN tot USING (lang) GROUP BY ALL)
SELECT lang, word, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score, word) AS rn FROM sc) WHERE rn <= 5""")
def ngram_score(spark, d):
    words = _vocabulary(spark, d)
    scored = ngram.score(words, ngram.train(words)).withColumn("score", F.round("score", 6))
    rn = F.row_number().over(Window.partitionBy("lang").orderBy("score", "word"))
    return scored.withColumn("rn", rn).filter("rn <= 5").withColumn("rn", F.col("rn").cast("long"))


@query(f"""WITH {_TOK}, pairs AS (SELECT lang, word, substr(word, 2, 1) || substr(word, 1, 1) || substr(word, 3) AS candidate FROM voc WHERE length(word) >= 4 AND substr(word, 1, 1) <> substr(word, 2, 1)),
both_ AS (SELECT lang, word FROM pairs UNION SELECT lang, candidate FROM pairs), {_GRAM.format(words='both_')},
sc AS (SELECT gr.lang, word, sum(ln((coalesce(model.cnt, 0) + 1) / (total + vocab))) AS score FROM gr LEFT JOIN model USING (lang, gram) JOIN tot USING (lang) GROUP BY ALL)
SELECT p.lang, p.word, p.candidate, round(b.score - a.score, 5) AS margin FROM pairs p JOIN sc a ON a.lang = p.lang AND a.word = p.word JOIN sc b ON b.lang = p.lang AND b.word = p.candidate""")
def ngram_margin_swap(spark, d):
    words = _vocabulary(spark, d)
    pairs = words.filter("length(word) >= 4 AND substr(word, 1, 1) <> substr(word, 2, 1)").select("lang", "word", F.expr("substr(word, 2, 1) || substr(word, 1, 1) || substr(word, 3)").alias("candidate"))
    return ngram.margins(pairs, ngram.train(words)).withColumn("margin", F.round("margin", 5))


@query(f"""WITH {_TOK}, w AS (SELECT lang, word, length(word) AS n FROM voc),
f AS (SELECT lang, unnest(list_distinct(flatten([list_transform(range(1, n), lambda i: substr(word, i, 2)), list_transform(range(1, n - 1), lambda i: substr(word, i, 3)), list_transform(range(1, n - 2), lambda i: substr(word, i, 4)), list_transform(range(1, least(n, 5) + 1), lambda i: '^' || substr(word, 1, i)), list_transform(range(1, least(n, 5) + 1), lambda i: right(word, i) || '$'), CASE WHEN n <= 5 THEN ['^' || word || '$'] ELSE [] END]))) AS feature FROM w)
SELECT lang, feature, count(*) AS n FROM f GROUP BY ALL""")
def presence_features(spark, d):
    return corpus.presence_features(_vocabulary(spark, d))


@query(f"WITH {_TOK}, o AS (SELECT lang, word, min((doc_id, pos)) AS first FROM tok GROUP BY ALL) SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY first) AS rank FROM o")
def lexicon_first_rank(spark, d):
    first = _tokens(spark, d).groupBy("lang", "word").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    placed = rank.ordinal(first, ["lang"], F.floor(F.col("first.doc_id") / 64), ["first"], "rank")
    return placed.select("lang", "word", F.col("rank").cast("long").alias("rank"))


# Candidates


@query(f"""WITH {_COMMON}, c AS (SELECT lang, word, unnest(list_transform(range(1, length(word)), lambda i: substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2))) AS candidate FROM rare)
SELECT DISTINCT c.lang, c.word, candidate FROM c JOIN lex ON lex.lang = c.lang AND lex.word = candidate WHERE candidate <> c.word""")
def adjacent_swap_candidates(spark, d):
    words = _vocabulary(spark, d)
    return candidates.transpositions(words.filter("cnt < 5"), words.filter("cnt >= 5"))


@query(f"""WITH {_COMMON}, s AS (SELECT lang, word AS candidate, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS word FROM lex),
c AS (SELECT DISTINCT rare.lang, rare.word, candidate FROM rare JOIN s USING (lang, word)) SELECT lang, word, min(candidate) AS candidate FROM c GROUP BY ALL HAVING count(*) = 1""")
def missing_letter_unique(spark, d):
    words = _vocabulary(spark, d)
    return candidates.unique_only(candidates.missing_letters(words.filter("cnt < 5"), words.filter("cnt >= 5"))).select("lang", "word", "candidate")


@query(f"""WITH {_COMMON}, c AS (SELECT lang, word, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS candidate FROM rare)
SELECT DISTINCT c.lang, c.word, candidate FROM c JOIN lex ON lex.lang = c.lang AND lex.word = candidate""")
def extra_letter_candidates(spark, d):
    words = _vocabulary(spark, d)
    return candidates.extra_letters(words.filter("cnt < 5"), words.filter("cnt >= 5"))


@query(f"""WITH {_COMMON}, c AS (SELECT lang, word, unnest(list_transform(list_filter(range(1, length(word)), lambda i: substr(word, i, 1) = substr(word, i + 1, 1)), lambda i: substr(word, 1, i) || substr(word, i + 2))) AS candidate FROM rare)
SELECT DISTINCT c.lang, c.word, candidate FROM c JOIN lex ON lex.lang = c.lang AND lex.word = candidate""")
def repeated_letter_candidates(spark, d):
    words = _vocabulary(spark, d)
    return candidates.repeated_letters(words.filter("cnt < 5"), words.filter("cnt >= 5"))


@query(f"""WITH {_COMMON}, v AS (SELECT * FROM (VALUES ('a'), ('e'), ('i'), ('o'), ('u')) AS x(v)), p AS (SELECT lang, word, unnest(range(1, length(word) + 1)) AS i FROM rare),
c AS (SELECT lang, word, substr(word, 1, i - 1) || v || substr(word, i + 1) AS candidate FROM p, v WHERE substr(word, i, 1) IN ('a', 'e', 'i', 'o', 'u') AND v <> substr(word, i, 1))
SELECT DISTINCT c.lang, c.word, candidate FROM c JOIN lex ON lex.lang = c.lang AND lex.word = candidate""")
def vowel_confusion_candidates(spark, d):
    words = _vocabulary(spark, d)
    classes = {v: X.EN_VOWELS.replace(v, "") for v in X.EN_VOWELS}
    return candidates.class_substitutions(words.filter("cnt < 5"), words.filter("cnt >= 5"), classes)


@query(f"""WITH {_TOK}, k AS (SELECT DISTINCT lang, word, unnest(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS key FROM voc),
p AS (SELECT DISTINCT a.lang, a.word, b.word AS candidate FROM k a JOIN k b ON a.lang = b.lang AND a.key = b.key AND a.word <> b.word)
SELECT lang, word, candidate FROM p WHERE abs(length(word) - length(candidate)) <= 1 AND damerau_levenshtein(translate(word, '{_WIDE}', '{_BYTE}'), translate(candidate, '{_WIDE}', '{_BYTE}')) = 1""")
def deletion_key_neighbors(spark, d):
    words = _vocabulary(spark, d)
    return candidates.neighbours(words, words)


@query(f"""WITH {_TOK}, k AS (SELECT lang, word AS candidate, cnt, unnest(list_transform(range(2, least(8, length(word) - 1) + 1), lambda n: substr(word, 1, n))) AS prefix FROM voc WHERE length(word) > 2),
q AS (SELECT DISTINCT lang, substr(word, 1, 3) AS prefix FROM voc WHERE length(word) >= 3)
SELECT lang, prefix, candidate, cnt, rank FROM (SELECT lang, prefix, candidate, cnt, row_number() OVER (PARTITION BY lang, prefix ORDER BY cnt DESC, candidate) AS rank FROM k JOIN q USING (lang, prefix)) WHERE rank <= 5""")
def prefix_completion_topk(spark, d):
    words = _vocabulary(spark, d)
    prefixes = words.filter("length(word) >= 3").select("lang", F.substring("word", 1, 3).alias("prefix"))
    return candidates.completions(prefixes, words, 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_COMMON}, s AS (SELECT lang, word, unnest(range(3, length(word) - 2)) AS i FROM rare WHERE length(word) >= 6), x AS (SELECT lang, word, substr(word, 1, i) AS left_, substr(word, i + 1) AS right_ FROM s)
SELECT x.lang, x.word, left_ AS "left", right_ AS "right" FROM x JOIN lex a ON a.lang = x.lang AND a.word = left_ JOIN lex b ON b.lang = x.lang AND b.word = right_""")
def boundary_split(spark, d):
    words = _vocabulary(spark, d)
    return candidates.glued(words.filter("cnt < 5"), words.filter("cnt >= 5"))


@query(f"""WITH {_COMMON}, n AS (SELECT lang, word AS first, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM tok)
SELECT n.lang, first, second, first || second AS merged, count(*) AS n FROM n JOIN lex ON lex.lang = n.lang AND lex.word = first || second WHERE second IS NOT NULL GROUP BY ALL""")
def split_pair_merge(spark, d):
    return candidates.split_pairs(contexts.pairs(read(spark, d, "documents")), _common(spark, d))


@query(f"""WITH {_COMMON}, n AS (SELECT DISTINCT lang, word AS first, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM tok),
m AS (SELECT *, substr(first, 1, length(first) - 1) AS l, substr(first, length(first), 1) || second AS r FROM n WHERE second IS NOT NULL AND length(first) >= 3)
SELECT m.lang, first, second, l AS "left", r AS "right" FROM m JOIN lex a ON a.lang = m.lang AND a.word = l JOIN lex b ON b.lang = m.lang AND b.word = r""")
def moved_letter_pairs(spark, d):
    return candidates.moved_letter(contexts.pairs(read(spark, d, "documents")), _common(spark, d))


# Ranking


@query("""WITH s AS (SELECT l_orderkey, l_partkey, sum(l_extendedprice * (1 - l_discount)) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(score, 6) DESC, l_partkey) AS rn FROM s)
SELECT l_orderkey, max(CASE WHEN rn = 1 THEN l_partkey END) AS best, round(max(CASE WHEN rn = 1 THEN score END), 6) AS best_score, max(CASE WHEN rn = 2 THEN l_partkey END) AS second, round(max(CASE WHEN rn = 1 THEN score END) - max(CASE WHEN rn = 2 THEN score END), 6) AS margin FROM r WHERE rn <= 2 GROUP BY l_orderkey""")
def best_two_margin(spark, d):
    scores = read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"))
    return rank.best_two(scores, ["l_orderkey"], "score", "l_partkey")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn, lead(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS nxt FROM c)
SELECT user_id, event_type AS best FROM r WHERE rn = 1 AND (nxt IS NULL OR n - nxt >= 5)""")
def best_with_gap(spark, d):
    counts = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    return rank.best_with_gap(counts, ["user_id"], "n", "event_type", 5.0).select("user_id", "best")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return rank.latest(read(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type", "value")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(CASE WHEN i = (n - 1) * 50 // 100 THEN value END) AS p50, max(CASE WHEN i = (n - 1) * 90 // 100 THEN value END) AS p90, max(CASE WHEN i = (n - 1) * 99 // 100 THEN value END) AS p99 FROM r GROUP BY event_type""")
def latency_floor_rank(spark, d):
    return rank.floor_rank(read(spark, d, "events"), ["event_type"], "value", {"p50": 50, "p90": 90, "p99": 99})


@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, max(value) AS largest FROM events GROUP BY event_type")
def latency_nearest_rank(spark, d):
    return rank.nearest_rank(read(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(f"WITH {_TOK}, r AS (SELECT lang, word, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) AS rn FROM voc) SELECT lang, word, cnt FROM r WHERE rn <= 12")
def value_counts_topk(spark, d):
    return rank.top_counts(_tokens(spark, d), ["lang"], "word", 12)


@query(f"""WITH {_TOK}, f AS (SELECT doc_id, lang, pos, word, array_to_string(list_concat(list_concat(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ['_']), list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)), ' ') AS context FROM tok),
g AS (SELECT lang, word, context, min((doc_id, pos)) AS first FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, word ORDER BY first) AS rn FROM g) SELECT lang, word, context, rn FROM r WHERE rn <= 4""")
def context_frame_2(spark, d):
    return rank.context_frames(contexts.frames(read(spark, d, "documents"))).withColumn("rn", F.col("rn").cast("long"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n, max(n) OVER (PARTITION BY user_id) - n AS lead_by FROM c QUALIFY lead_by <= 2""")
def ambiguous_within_margin(spark, d):
    counts = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rank.within_margin(counts, ["user_id"], "n", 2)


@query("""WITH a AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS in_lane FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY in_lane, value DESC, event_id) AS place FROM a WHERE in_lane <= 2) SELECT user_id, event_type, event_id, place FROM b WHERE place <= 6""")
def lane_quota_topk(spark, d):
    found = rank.lane_quota(read(spark, d, "events"), ["user_id"], "event_type", [F.desc("value"), F.col("event_id")], 2, 6)
    return found.select("user_id", "event_type", "event_id", F.col("place").cast("long").alias("place"))


# Journals


@query(f"""WITH {_TOK}, c AS (SELECT doc_id, pos, word, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ctx FROM tok), k AS (SELECT unnest(list_transform(range(1, least(5, len(ctx)) + 1), lambda n: array_to_string(ctx[len(ctx) - n + 1 : len(ctx)], ' '))) AS key, word FROM c)
SELECT key, word, count(*) AS cnt FROM k WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""")
def context_backoff_keys(spark, d):
    return contexts.frequent(read(spark, d, "documents"), 3)


@query("""WITH b AS (SELECT user_id % 10 AS source, event_type AS operation, event_id % 7 AS state, count(*) AS w FROM events GROUP BY ALL)
SELECT source, operation, state, sum(w)::BIGINT AS weight FROM (SELECT source::VARCHAR AS source, operation, state, w FROM b UNION ALL SELECT '*', operation, state, w FROM b UNION ALL SELECT '*', '*', state, w FROM b) GROUP BY ALL""")
def wildcard_rollup(spark, d):
    rows = read(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("source"), F.col("event_type").alias("operation"), (F.col("event_id") % 7).alias("state"))
    return journal.wildcard_counts(rows, "source", "operation", ["state"], F.lit(1))


@query("SELECT event_type AS map_name, user_id, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 6 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 WHEN 'error' THEN 8 END)::BIGINT AS cnt FROM (SELECT DISTINCT * FROM events) GROUP BY ALL")
def weighted_usage_counts(spark, d):
    return journal.weighted_counts(read(spark, d, "events"), "event_type", {"view": 1, "click": 6, "purchase": 5, "signup": 3, "error": 8}, "user_id")


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS count, min(event_id) AS first_ts, max(event_id) AS last_ts FROM events WHERE value > 20 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY count < 2, first_ts, event_type) AS rn FROM p) SELECT user_id, event_type, count, first_ts, last_ts, rn = 1 AND count >= 2 AS promoted FROM r""")
def promotion_threshold(spark, d):
    return journal.promoted(read(spark, d, "events").filter("value > 20"), "user_id", "event_type", "event_id")


@query("SELECT user_id, event_id % 50 AS item, count(*) AS weight FROM events e WHERE event_type IN ('click', 'view') AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND x.event_id % 50 = e.event_id % 50) GROUP BY ALL HAVING count(*) >= 2")
def accepted_anti_rejected(spark, d):
    rows = read(spark, d, "events").withColumn("item", F.col("event_id") % 50)
    return journal.accepted_without_rejected(rows, ["user_id", "item"], F.col("event_type").isin("click", "view"), F.col("event_type") == "error", F.lit(1), 2)


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'error') AS r FROM events GROUP BY user_id)
SELECT user_id, round((a + 1) / (a + r + 2), 6) AS posterior, round((a + r) / (a + r + 4), 6) AS confidence, round((2 * (a + 1) / (a + r + 2) - 1) * (a + r) / (a + r + 4), 6) AS weight FROM c""")
def signed_memory(spark, d):
    counts = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("a"), F.count_if(F.col("event_type") == "error").alias("r"))
    s = counts.select("user_id", journal.signed_signal(F.col("a"), F.col("r")).alias("s"))
    return s.select("user_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("posterior", "confidence", "weight")])


@query(f"WITH {_TOK} SELECT lang, word, round(least(greatest(ln(cnt + 1) * 0.036, 0), 0.22), 6) AS prior FROM voc")
def word_prior(spark, d):
    return _vocabulary(spark, d).select("lang", "word", F.round(journal.prior_from_count(F.col("cnt")), 6).alias("prior"))


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (value > 20) AS high, round(sum(value), 4) AS sum_value, max(event_id) AS last_seen, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)""")
def scoreboard_rollup(spark, d):
    return read(spark, d, "events").rollup("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 20).alias("high"), F.round(F.sum("value"), 4).alias("sum_value"), F.max("event_id").alias("last_seen"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def adjacent_dup_drop(spark, d):
    return journal.without_adjacent_repeats(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""SELECT event_id, user_id, "after" FROM (SELECT event_id, user_id, coalesce(sum(strlen(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "after" FROM events) WHERE "after" < 200""")
def byte_tail(spark, d):
    return journal.byte_tail(read(spark, d, "events"), ["user_id"], "event_id", "props", 200).select("event_id", "user_id", "after")


@query("WITH b AS (SELECT user_id, event_id % 20 AS item FROM events GROUP BY ALL HAVING min(event_type) <> max(event_type)) SELECT event_id, e.user_id, e.event_id % 20 AS item FROM events e JOIN b ON b.user_id = e.user_id AND b.item = e.event_id % 20")
def conflicting_evidence(spark, d):
    return journal.conflicts(read(spark, d, "events").withColumn("item", F.col("event_id") % 20), ["user_id", "item"], "event_type").select("event_id", "user_id", "item")


@query("SELECT key, sum(cnt)::BIGINT AS cnt FROM (SELECT event_type AS key, count(*) AS cnt FROM events WHERE user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events WHERE value > 10 GROUP BY 1) GROUP BY key")
def merge_count_maps(spark, d):
    e = read(spark, d, "events")
    part = lambda x: x.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("cnt"))
    return journal.merged_counts(part(e.filter("user_id % 2 = 0")), part(e.filter("value > 10")))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, i, n, value AS ema FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.n, f.ema * 0.8 + o.value * 0.2 FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) SELECT user_id, n, round(ema, 5) AS ema FROM f WHERE i = n""")
def ema_in_order(spark, d):
    return journal.ema(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 0.2).withColumn("ema", F.round("ema", 5))


# State machines over events, one user a session


_SEC = "epoch_us(ts) / 1e6"


@query(f"""WITH a AS (SELECT *, event_type = 'click' AS tap, {_SEC} - lag({_SEC}) OVER w AS gap, lag(event_type = 'click') OVER w AS tapped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(CASE WHEN NOT tap OR NOT coalesce(tapped, false) OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place FROM b WHERE tap)
SELECT event_id, user_id FROM c WHERE place % 2 = 0""")
def double_tap_batch(spark, d):
    return batch.double_taps(read(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", F.col("event_type") == "click", 86400.0).select("event_id", "user_id")


@query(f"""WITH a AS (SELECT *, CASE WHEN {_SEC} - lag({_SEC}) OVER w <= 21600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS burst FROM a)
SELECT user_id, burst, min(event_id) AS first_id, count(*) AS n FROM b GROUP BY ALL""")
def burst_sessions(spark, d):
    e = read(spark, d, "events")
    found = batch.bursts(e, "user_id", ["ts", "event_id"], "ts", 21600.0)
    return found.join(e.select("user_id", F.col("ts").alias("first_ts"), "event_id"), ["user_id", "first_ts"]).groupBy("user_id", "burst", "n").agg(F.min("event_id").alias("first_id")).select("user_id", F.col("burst").cast("long").alias("burst"), "first_id", "n")


@query(f"""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), o AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT p.event_id, p.user_id, p.ts AS t0, o.event_id AS oid, o.ts AS t1, row_number() OVER (PARTITION BY p.event_id ORDER BY o.ts, o.event_id) AS rn FROM p LEFT JOIN o ON o.user_id = p.user_id AND (o.ts, o.event_id) > (p.ts, p.event_id))
SELECT event_id, user_id, CASE WHEN (epoch_us(t1) - epoch_us(t0)) / 1e6 <= 36000 THEN oid END AS outcome_id FROM m WHERE rn = 1""")
def asof_outcome(spark, d):
    found = batch.outcomes(read(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", F.col("event_type") == "click", F.col("event_type") == "purchase", ["event_id"], 36000.0)
    return found.select("event_id", "user_id", F.col("hit.event_id").alias("outcome_id"))


@query(f"WITH g AS (SELECT user_id, lead({_SEC}) OVER (PARTITION BY user_id ORDER BY ts, event_id) - {_SEC} AS gap FROM events) SELECT user_id, count(*) FILTER (gap > 43200) AS expired, count(*) FILTER (gap <= 43200) AS live FROM g GROUP BY user_id")
def gesture_expiry(spark, d):
    return batch.gesture_states(read(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", 43200.0)


# Corpus


@query(f"""WITH {_COMMON}, p AS (SELECT lang, word, ('0x' || substr(sha256(word), 1, 7))::BIGINT AS pick, length(word) AS n FROM lex), q AS (SELECT *, pick % greatest(n - 1, 1) + 1 AS i, pick // 7 % 5 AS way FROM p)
SELECT lang, word, CASE way WHEN 0 THEN 'omission' WHEN 1 THEN 'repeat' WHEN 2 THEN 'swap' WHEN 3 THEN 'layout' ELSE 'split' END AS operation,
CASE way WHEN 0 THEN substr(word, 1, i - 1) || substr(word, i + 1) WHEN 1 THEN substr(word, 1, i) || substr(word, i) WHEN 2 THEN substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) WHEN 3 THEN translate(word, '{_US}', '{_RU}') ELSE substr(word, 1, i) || ' ' || substr(word, i + 1) END AS damaged FROM q""")
def corruption_rows(spark, d):
    made = _common(spark, d).select("lang", "word", corpus.corruption(F.col("word"), corpus.stable_number(F.col("word"))).alias("c"))
    return made.select("lang", "word", "c.operation", "c.damaged")


@query(f"""WITH {_TOK}, c AS (SELECT lang, word, coalesce(lead(word) OVER (PARTITION BY lang, length(word), substr(word, 1, 1) ORDER BY word), min(word) OVER (PARTITION BY lang, length(word), substr(word, 1, 1))) AS x FROM voc) SELECT lang, word, CASE WHEN x <> word THEN x END AS distractor FROM c""")
def cyclic_distractor(spark, d):
    return corpus.cyclic_distractors(_vocabulary(spark, d).select("lang", "word"))


@query(f"WITH {_TOK} SELECT lang, ('0x' || substr(sha256(word), 1, 2))::BIGINT < 26 AS held_out, count(*) AS n FROM voc GROUP BY ALL")
def heldout_hash_split(spark, d):
    return _vocabulary(spark, d).groupBy("lang", corpus.held_out(F.col("word")).alias("held_out")).agg(F.count("*").alias("n"))


@query(f"WITH {_TOK}, n AS (SELECT lang, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS successor FROM tok), c AS (SELECT lang, word, successor, count(*) AS support FROM n WHERE successor IS NOT NULL GROUP BY ALL) SELECT lang, word, successor, support FROM c QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY support DESC, successor) = 1")
def next_token_top1(spark, d):
    return corpus.next_token_top1(contexts.pairs(read(spark, d, "documents")))


@query(f"WITH {_TOK}, w AS (SELECT lang, word, 1 + least(7, floor(log2(cnt))::BIGINT) AS n FROM voc) SELECT lang, sum(n)::BIGINT AS copies, max(n) AS most FROM w GROUP BY lang")
def weighted_lexicon(spark, d):
    return corpus.weighted_lexicon(_vocabulary(spark, d)).groupBy("lang").agg(F.count("*").alias("copies"), F.max("copy").cast("long").alias("most"))


@query("SELECT lang, toxic, count(*) AS total, count(*) FILTER (quality = 1) AS ok, round(count(*) FILTER (quality = 1) / count(*), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def eval_accuracy_by_label(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return corpus.accuracy(rows, ["lang", "toxic"], F.col("quality") == 1)


@query("WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, 0 AS side, c_name AS name FROM customer), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, 1 AS side, s_name FROM supplier) SELECT * FROM a UNION ALL SELECT * FROM b")
def zip_longest(spark, d):
    # Keys are dense from one or nought; the ordinal is the rank of the key within its part plus the parts before it.
    rows = lambda t, k, n: _ordinal(read(spark, d, t).select(F.col(k).alias("k"), F.col(n).alias("name")), "k")
    return corpus.zip_longest(rows("customer", "c_custkey", "c_name"), rows("supplier", "s_suppkey", "s_name"), "i", "name")


def _ordinal(df: DataFrame, key: str) -> DataFrame:
    """df with i, its place by key from 1: ranks within ranges of the key plus the counts of the ranges before."""
    ranged = df.withColumn("part", F.floor(F.col(key) / 4096))
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(key))).join(before.select("part", "before"), "part").withColumn("i", F.col("r") + F.col("before")).drop("part", "r", "before")


@query(f"WITH {_TOK}, s AS (SELECT DISTINCT word, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS source FROM voc) SELECT word, min(source) AS source, count(*) AS n FROM s GROUP BY word")
def union_first_source_wins(spark, d):
    v = _vocabulary(spark, d)
    return corpus.first_source_wins([v.filter("lang = 'en'"), v.filter("lang = 'de'"), v.filter("lang NOT IN ('en', 'de')")], "word")


@query("""WITH a AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
c AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.n, 0) - coalesce(a.n, 0) AS x FROM a FULL JOIN b ON a.event_type = b.event_type AND a.user_id = b.user_id)
SELECT CASE WHEN x > 0 THEN 'current' ELSE 'base' END AS side, event_type, user_id, abs(x) AS n FROM c WHERE x <> 0""")
def multiset_diff(spark, d):
    e = read(spark, d, "events")
    return corpus.multiset_difference(e.filter("event_id % 2 = 0").select("event_type", "user_id"), e.filter("event_id % 2 = 1").select("event_type", "user_id"))


@query("""WITH t AS (SELECT unnest([5.0, 10.0, 20.0, 40.0]) AS threshold), r AS (SELECT threshold, value >= threshold AS hit, event_type = 'purchase' AS y FROM events, t), c AS (SELECT threshold, count(*) FILTER (hit AND y) AS tp, count(*) FILTER (hit AND NOT y) AS fp, count(*) FILTER (NOT hit AND y) AS fn FROM r GROUP BY threshold)
SELECT threshold::DOUBLE AS threshold, tp, fp, fn, CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END::DOUBLE AS f1 FROM c""")
def threshold_sweep(spark, d):
    e = read(spark, d, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return corpus.threshold_sweep(e, "value", "y", [5.0, 10.0, 20.0, 40.0])


@query("""WITH RECURSIVE p AS (SELECT a.doc_id, a.text AS x, b.text AS y, least(length(a.text), length(b.text)) AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
h AS (SELECT doc_id, 0 AS lo, n AS hi FROM p UNION ALL SELECT h.doc_id, CASE WHEN left(x, (lo + hi + 1) // 2) = left(y, (lo + hi + 1) // 2) THEN (lo + hi + 1) // 2 ELSE lo END, CASE WHEN left(x, (lo + hi + 1) // 2) = left(y, (lo + hi + 1) // 2) THEN hi ELSE (lo + hi + 1) // 2 - 1 END FROM h JOIN p ON p.doc_id = h.doc_id WHERE lo < hi),
l AS (SELECT p.*, lo AS lead_ FROM p JOIN h ON p.doc_id = h.doc_id AND lo = hi),
t AS (SELECT doc_id, 0 AS lo, n - lead_ AS hi FROM l UNION ALL SELECT t.doc_id, CASE WHEN right(x, (lo + hi + 1) // 2) = right(y, (lo + hi + 1) // 2) THEN (lo + hi + 1) // 2 ELSE lo END, CASE WHEN right(x, (lo + hi + 1) // 2) = right(y, (lo + hi + 1) // 2) THEN hi ELSE (lo + hi + 1) // 2 - 1 END FROM t JOIN l ON l.doc_id = t.doc_id WHERE lo < hi)
SELECT l.doc_id, lo AS move_left, length(x) - lead_ - lo AS backspaces, substr(y, lead_ + 1, length(y) - lead_ - lo) AS "insert" FROM l JOIN t ON l.doc_id = t.doc_id AND lo = hi""")
def edit_plan(spark, d):
    docs = read(spark, d, "documents")
    pairs = docs.select("doc_id", F.col("text").alias("x")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("y")), "doc_id")
    return pairs.select("doc_id", distance.whole_text_edit("x", "y").alias("e")).select("doc_id", "e.*")


# Decisions and reports


@query(rf"""WITH x AS (SELECT conv_id, turn, text FROM conversations), r AS (SELECT conv_id, turn, regexp_extract_all(text, '\s+|\S+') AS p, text FROM x),
f AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], '\S')) AS spots, list_transform(p, lambda x: CASE WHEN regexp_matches(x, '\S') THEN CASE WHEN length(regexp_replace(x, '[^а-яА-ЯёЁ]', '', 'g')) > length(regexp_replace(x, '[^A-Za-z]', '', 'g')) THEN translate(x, '{_RU}', '{_US}') ELSE translate(x, '{_US}', '{_RU}') END ELSE x END) AS q FROM r),
m AS (SELECT conv_id, turn, 0 AS ord, 'keep' AS name, text AS candidate FROM f UNION ALL SELECT conv_id, turn, 1, 'flip_all', CASE WHEN length(regexp_replace(text, '[^а-яА-ЯёЁ]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN translate(text, '{_RU}', '{_US}') ELSE translate(text, '{_US}', '{_RU}') END FROM f
UNION ALL SELECT conv_id, turn, 2, 'flip_first', array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = spots[1] THEN q[i] ELSE p[i] END), '') FROM f UNION ALL SELECT conv_id, turn, 3, 'flip_last', array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = spots[-1] THEN q[i] ELSE p[i] END), '') FROM f
UNION ALL SELECT conv_id, turn, 4, 'flip_each', array_to_string(q, '') FROM f)
SELECT conv_id * 1000 + turn AS id, ord, name, candidate FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, turn, candidate ORDER BY ord) = 1""")
def candidate_map(spark, d):
    texts = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return decide.candidate_map(texts, "id", "text").select("id", "ord", "name", "candidate")


@query(f"""WITH {_COMMON}, w AS (SELECT lang, word FROM voc WHERE cnt < 5), gw AS (SELECT DISTINCT lang, word, unnest(list_transform(range(1, length(word) + 2), lambda i: substr('^^' || word || '$', i, 3))) AS gram FROM w),
gl AS (SELECT DISTINCT lang, word AS candidate, unnest(list_transform(range(1, length(word) + 2), lambda i: substr('^^' || word || '$', i, 3))) AS gram FROM lex), o AS (SELECT gw.lang, gw.word, candidate, count(*) AS overlap FROM gw JOIN gl USING (lang, gram) WHERE gw.word <> candidate GROUP BY ALL HAVING count(*) >= 3)
SELECT lang, word, candidate, overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY lang, word ORDER BY overlap DESC, candidate) AS place FROM o) WHERE place <= 4""")
def surface_overlap_candidates(spark, d):
    words = _vocabulary(spark, d)
    found = decide.overlap_candidates(words.filter("cnt < 5"), words.filter("cnt >= 5"), 3, 4)
    return found.select("lang", "word", "candidate", F.col("overlap").cast("long").alias("overlap"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {_TOK}, k AS (SELECT unnest([2, 3, 4]) AS length, word, cnt FROM voc), s AS (SELECT length, substr(word, 1, length) AS prefix, sum(cnt)::BIGINT AS support, count(*) AS words FROM k WHERE length(word) >= length GROUP BY ALL)
SELECT length, prefix, support, words, place FROM (SELECT *, row_number() OVER (PARTITION BY length ORDER BY support DESC, prefix) AS place FROM s) WHERE place <= 20""")
def hot_prefix_frontier(spark, d):
    found = decide.prefix_frontier(_vocabulary(spark, d), [2, 3, 4], 20)
    return found.select("length", "prefix", "support", "words", F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber AS priority, l_returnflag AS rule_id, l_partkey AS replacement, l_quantity AS score FROM lineitem),
r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY round(score, 6) DESC, priority, rule_id, replacement))
SELECT l_orderkey, replacement, CASE WHEN nxt IS NULL THEN 'single' WHEN score - nxt >= 5 THEN 'strong' ELSE 'weak' END AS confidence FROM r WHERE place = 1""")
def typing_confidence(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("priority"), F.col("l_returnflag").alias("rule_id"), F.col("l_partkey").alias("replacement"), F.col("l_quantity").alias("score"))
    return decide.confidence(rows, "l_orderkey", 5.0)


@query(r"""WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'candidate_before_apply' WHEN 'view' THEN 'candidate_before_apply' ELSE 'replacement' END AS kind, CASE WHEN user_id % 3 = 0 THEN 'block_unsafe' ELSE 'apply' END AS action_kind, event_id % 5 <> 0 AS safety, event_id % 7 = 0 AS boundary, event_id % 11 = 0 AS word_count, event_id % 13 = 0 AS non_last, event_id % 4 AS touch, event_id % 6 = 0 AS moved, event_id % 12 <> 0 AS verified, event_type || ' ' || props AS from_, CASE event_id % 3 WHEN 0 THEN event_type || ' x ' || props WHEN 1 THEN 'other ' || props ELSE '' END AS to_, CASE WHEN user_id % 2 = 0 THEN 'nanda' ELSE 'rules' END AS src FROM events),
w AS (SELECT *, list_filter(regexp_split_to_array(from_, '\s+'), lambda x: x <> '') AS x, list_filter(regexp_split_to_array(to_, '\s+'), lambda x: x <> '') AS y FROM e)
SELECT event_id, CASE WHEN kind = 'candidate_before_apply' THEN CASE WHEN action_kind = 'block_unsafe' AND NOT safety THEN '' ELSE array_to_string(list_filter([CASE WHEN boundary OR word_count THEN 'boundary_changed' END, CASE WHEN non_last OR touch > 1 THEN 'multiword_touch' END, CASE WHEN NOT safety THEN 'safety_block' END, CASE WHEN moved THEN 'transition_left_context_changed' END, CASE WHEN moved AND NOT verified THEN 'unverified_transition' END], lambda v: v IS NOT NULL), ',') END
WHEN from_ <> '' AND to_ <> '' THEN array_to_string(list_filter([CASE WHEN len(x) <> len(y) THEN 'word_count_changed' END, CASE WHEN len(x) >= 2 AND len(x) = len(y) AND x[1:len(x) - 1] <> y[1:len(y) - 1] THEN 'left_context_changed' END, CASE WHEN src = 'nanda' AND len(x) >= 2 THEN 'nanda_multiword' END], lambda v: v IS NOT NULL), ',') ELSE '' END AS reasons FROM w""")
def unsafe_reasons(spark, d):
    # Journal records made of events: their fields are what the rules read.
    e, id_, user = read(spark, d, "events"), F.col("event_id"), F.col("user_id")
    fields = {
        "kind": F.when(F.col("event_type").isin("click", "view"), "candidate_before_apply").otherwise("replacement"), "action_kind": F.when(user % 3 == 0, "block_unsafe").otherwise("apply"), "safety_allow_apply": id_ % 5 != 0,
        "boundary_changed": id_ % 7 == 0, "word_count_changed": id_ % 11 == 0, "changes_non_last_word": id_ % 13 == 0, "would_touch_words": id_ % 4, "transition_left_context_changed": id_ % 6 == 0, "transition_verified": id_ % 12 != 0,
        "from": F.concat_ws(" ", "event_type", "props"), "to": F.when(id_ % 3 == 0, F.concat(F.col("event_type"), F.lit(" x "), F.col("props"))).when(id_ % 3 == 1, F.concat(F.lit("other "), F.col("props"))).otherwise(""), "selected_source": F.when(user % 2 == 0, "nanda").otherwise("rules"),
    }
    return e.select("event_id", F.array_join(decide.unsafe_reasons(fields.get), ",").alias("reasons"))


@query("""WITH r AS (SELECT l_orderkey, l_extendedprice AS score, (l_returnflag = 'R')::INT AS label, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_extendedprice, 6) DESC, l_linenumber) = 1 AS best FROM lineitem)
SELECT count(DISTINCT l_orderkey) AS groups, count(*) FILTER (best AND label = 1) AS "right", count(*) FILTER (best AND label = 0) AS false_positive, count(*) FILTER (NOT best AND label = 1) AS false_negative, round(count(*) FILTER (best AND label = 1) / count(DISTINCT l_orderkey), 6) AS accuracy FROM r""")
def group_argmax_eval(spark, d):
    rows = read(spark, d, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return decide.group_argmax(rows, "l_orderkey", "l_extendedprice", "label", "l_linenumber")


@query("SELECT event_id, event_type FROM (SELECT *, sha256(event_id::VARCHAR) AS h FROM events ORDER BY h LIMIT 500)")
def hashed_sample(spark, d):
    return decide.hashed_sample(read(spark, d, "events"), F.col("event_id"), 500).select("event_id", "event_type")


@query("WITH c AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS cell FROM embeddings) SELECT label, cell, round(atan2(avg(sin(v::DOUBLE)), avg(cos(v::DOUBLE))), 5) AS mean, count(*) AS n FROM c GROUP BY ALL")
def phase_centers(spark, d):
    found = decide.centers(read(spark, d, "embeddings"), "label", "embedding")
    return found.select("label", F.col("cell").cast("long").alias("cell"), F.round("mean", 5).alias("mean"), "n")


@query("""WITH j AS (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, value FROM events) SELECT event_type, CASE WHEN k <= 2 THEN '0-2' WHEN k = 3 THEN '3' WHEN k <= 7 THEN '4-7' ELSE '8+' END AS depth, count(*) AS n, round(avg(value), 6) AS mean, min(k) AS least FROM j GROUP BY ALL""")
def depth_report(spark, d):
    rows = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.groupBy("event_type", X.depth_bucket(F.col("k")).alias("depth")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("k").alias("least"))


@query("SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def journal_tail(spark, d):
    return journal.kept_tail(read(spark, d, "events"), 200, "ts", "event_id").select("event_id", "user_id", "value")


@query(r"""WITH p AS (SELECT doc_id, trim(f, ' ') AS fragment FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\n\r.!?;]')) AS f FROM documents)),
t AS (SELECT doc_id, fragment, len(list_filter(regexp_split_to_array(fragment, '[^\p{L}-]+'), lambda x: x <> '')) AS n FROM p WHERE fragment <> '')
SELECT doc_id, count(*) AS fragments, count(*) FILTER (strlen(fragment) > 400) AS oversized, count(*) FILTER (strlen(fragment) <= 400 AND n < 3) AS short FROM t GROUP BY doc_id""")
def fragment_scan(spark, d):
    found = sources.fragments(read(spark, d, "documents"), 3, 400)
    return found.groupBy("doc_id").agg(F.count("*").alias("fragments"), F.count_if(F.col("reject") == "oversized").alias("oversized"), F.count_if(F.col("reject") == "tokens").alias("short"))


@query("""WITH g AS (SELECT group_id, min(original) AS original, max(CASE WHEN label = 1 THEN candidate END) AS expected FROM (SELECT user_id AS group_id, event_type AS original, event_id::VARCHAR AS candidate, (event_type = 'purchase')::INT AS label FROM events) GROUP BY group_id) SELECT * FROM g WHERE expected IS NOT NULL""")
def grouped_cases(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("group_id"), F.col("event_type").alias("original"), F.col("event_id").cast("string").alias("candidate"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    return sources.grouped_cases(rows)


@query(f"""WITH {_TOK}, l AS (SELECT word, coalesce(bool_or(lang = 'en' AND cnt >= 5), false) AS en, coalesce(bool_or(lang = 'de' AND cnt >= 5), false) AS ru, sum(CASE WHEN lang = 'en' THEN cnt ELSE 0 END) AS a, sum(CASE WHEN lang = 'de' THEN cnt ELSE 0 END) AS b FROM voc GROUP BY word)
SELECT word, CASE WHEN contains(word, '-') THEN 'special' WHEN length(word) > 20 THEN 'unavailable' WHEN en THEN 'english' WHEN ru THEN 'russian' WHEN a = 0 AND b = 0 THEN 'ambiguous' WHEN a > b THEN 'english' ELSE 'russian' END AS layout FROM l""")
def layout_decision(spark, d):
    # Two of the corpus languages stand in for the two layouts' lexicons: frequent words are known, hyphens special.
    side = lambda v: F.sum(F.when(F.col("lang") == v, F.col("cnt")).otherwise(0))
    known = lambda v: F.coalesce(F.bool_or((F.col("lang") == v) & (F.col("cnt") >= 5)), F.lit(False))
    counts = _vocabulary(spark, d).groupBy("word").agg(known("en").alias("en"), known("de").alias("ru"), side("en").alias("a"), side("de").alias("b"))
    status = lambda c: decide.layout_status(F.col(c), F.col("word").contains("-"), F.length("word") <= 20)
    return counts.select("word", decide.layout_decision(status("en"), status("ru"), F.col("a"), F.col("b")).alias("layout"))


@query(r"""SELECT DISTINCT token, regexp_extract(token, '^([^\p{L}\p{N}]*)', 1) AS lead, CASE WHEN regexp_matches(token, '[\p{L}\p{N}]') THEN regexp_extract(token, '([^\p{L}\p{N}]*)$', 1) ELSE '' END AS trail FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents) WHERE token <> ''""")
def edge_punctuation(spark, d):
    tokens = read(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("token")).filter("token != ''").distinct()
    parts = tokens.select("token", X.edge_punctuation(F.col("token")).alias("p"))
    return parts.select("token", "p.lead", "p.trail")


@query(f"WITH {_TOK}, s AS (SELECT word, unnest(range(1, length(word))) AS i FROM (SELECT DISTINCT word FROM voc WHERE cnt >= 5)) SELECT word, substr(word, 1, i) AS \"left\", substr(word, i + 1) AS \"right\" FROM s")
def word_splits(spark, d):
    words = _common(spark, d).select("word").distinct()
    return words.select("word", F.explode(X.splits(F.col("word"))).alias("s")).select("word", "s.left", "s.right")


@query(r"""SELECT doc_id, length(text) AS chars, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) ELSE 0 END, 6) AS alpha_share, len(regexp_extract_all(text, '\s+|\S+')) AS segments FROM documents""")
def text_quality(spark, d):
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.length(text).cast("long").alias("chars"), F.round(X.alpha_share(text), 6).alias("alpha_share"), F.size(X.segments(text)).cast("long").alias("segments"))


@query("""WITH p AS (SELECT a.conv_id, a.turn, regexp_split_to_array(lower(a.text), '\\s+') AS x0, regexp_split_to_array(lower(b.text), '\\s+') AS y0 FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
q AS (SELECT conv_id, turn, list_filter(list_transform(x0, lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda w: w <> '') AS x, list_filter(list_transform(y0, lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda w: w <> '') AS y FROM p)
SELECT conv_id, turn, CASE WHEN len(x) <> len(y) THEN greatest(len(x), len(y)) ELSE len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i])) END AS changed FROM q""")
def changed_token_count(spark, d):
    c = read(spark, d, "conversations")
    pairs = c.select("conv_id", "turn", F.col("text").alias("x")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", X.changed_words(F.col("x"), F.col("y")).cast("long").alias("changed"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_discount * 100, 6) DESC, l_linenumber % 3, l_returnflag, l_partkey * 10 + l_linenumber) AS place FROM lineitem""")
def typing_candidate_order(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100).alias("score"), (F.col("l_linenumber") % 3).alias("priority"), F.col("l_returnflag").alias("rule_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("replacement"))
    return decide.ranked(rows, "l_orderkey").select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("""SELECT l_orderkey, l_linenumber, round(least(greatest(l_discount * 10 * 0.55 + l_tax + 0.10 * l_quantity / 50 - CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 0 END, -1), 1), 6) AS posterior FROM lineitem""")
def candidate_posterior(spark, d):
    risk = F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    value = decide.posterior(F.col("l_discount") * 10, F.col("l_tax"), F.col("l_quantity") / 50, risk)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 6).alias("posterior"))


@query(f"WITH {_TOK} SELECT doc_id, pos, word, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)[1] AS oldest, count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS n FROM tok")
def completed_tail_context(spark, d):
    at = F.transform("words", lambda w, i: F.struct(i.cast("long").alias("pos"), w.alias("word"), F.when(i > 0, F.get("words", F.greatest(i - 24, F.lit(0)))).alias("oldest"), F.least(i, F.lit(24)).cast("long").alias("n")))
    return contexts.token_arrays(read(spark, d, "documents")).select("doc_id", F.explode(at).alias("x")).select("doc_id", "x.*")


@query("""WITH m AS (SELECT event_type AS map_name, user_id AS key, count(*) AS cnt FROM events GROUP BY ALL), k AS (SELECT key, count(*) AS maps FROM m GROUP BY key)
SELECT map_name, count(*) AS keys, sum(cnt)::BIGINT AS total, count(*) FILTER (maps > 1) AS shared FROM m JOIN k USING (key) GROUP BY map_name""")
def usage_state_summary(spark, d):
    counts = read(spark, d, "events").groupBy(F.col("event_type").alias("map_name"), F.col("user_id").alias("key")).agg(F.count("*").alias("cnt"))
    maps = F.count("*").over(Window.partitionBy("key"))
    return counts.withColumn("maps", maps).groupBy("map_name").agg(F.count("*").alias("keys"), F.sum("cnt").alias("total"), F.count_if(F.col("maps") > 1).alias("shared"))


@query("""SELECT user_id, ('0x' || substr(sha256(user_id::VARCHAR), 1, 2))::BIGINT < 51 AS held_out, count(*) AS n FROM events GROUP BY ALL""")
def group_split(spark, d):
    return read(spark, d, "events").groupBy("user_id", corpus.held_out(F.col("user_id").cast("string"), 51).alias("held_out")).agg(F.count("*").alias("n"))
