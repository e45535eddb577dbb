"""Queries of usage memory, packages, key streams, corpora and reports; they join those of keyloom.plans.queries on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import surface as S, text as X
from keyloom.operators import candidates, contexts, corpus, keys, memory, rank
from keyloom.plans.edits import _TURNS, _damaged, _memory, _near, _turns, _DAMAGED, _LESS, _MOVED, _NEAR, _RUNS, _SWAPPED
from keyloom.plans.queries import _COMMON, _RU, _TOK, _US, _common, _vocabulary, query, read

# Usage

_SPOKEN = f"said AS (SELECT role, unnest({_memory('coalesce(text, chr(32))')}) AS word FROM conversations)"


def _said(spark, d):
    return read(spark, d, "conversations").select("role", F.explode(S.memory_words(F.coalesce("text", F.lit(" ")))).alias("word"))


@query(rf"""WITH {_SPOKEN}, a AS (SELECT word, count(*) AS cnt FROM said WHERE role = 'assistant' GROUP BY word), t AS (SELECT word, count(*) AS cnt FROM said WHERE role = 'user' GROUP BY word)
SELECT a.word, a.cnt * 4 + least(coalesce(t.cnt, 0), 50) AS score, row_number() OVER (ORDER BY a.cnt * 4 + least(coalesce(t.cnt, 0), 50) DESC, length(a.word), a.word) AS place FROM a LEFT JOIN t USING (word) WHERE regexp_matches(a.word, '^[\p{{L}}-]+\z') AND length(a.word) BETWEEN 2 AND 32""")
def usage_surfaces(spark, d):
    counts = lambda role: _said(spark, d).filter(F.col("role") == role).groupBy("word").agg(F.count("*").alias("cnt"))
    found = memory.surfaces(counts("assistant"), counts("user"))
    placed = rank.ordinal(found.withColumn("k", F.lit(0)), ["k"], -F.col("score"), [F.length("word"), F.col("word")], "place")
    return placed.select("word", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {_TURNS}, m AS (SELECT list_distinct({_memory('x')}) AS a, {_memory('y')} AS b FROM p), w AS (SELECT unnest(list_filter(a, lambda v: NOT list_contains(b, v))) AS word FROM m) SELECT word, count(*) AS weight FROM w GROUP BY word""")
def rejected_sources(spark, d):
    return memory.rejected_sources(_turns(spark, d), "x", "y")


@query(f"""WITH c AS (SELECT role, turn, text, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY ALL), m AS (SELECT {_memory('text')} AS w, n + CASE WHEN role = 'assistant' THEN 3 ELSE 0 END AS w_ FROM c) SELECT w[-1] AS word, sum(w_)::BIGINT AS weight FROM m WHERE len(w) > 0 GROUP BY 1""")
def promoted_target_counts(spark, d):
    rows = read(spark, d, "conversations").filter("text is not null").groupBy("role", "turn", "text").agg(F.count("*").alias("n"))
    return memory.promoted_counts(rows, "text", "n", F.col("role") == "assistant")


@query(f"""WITH {_TOK}, e AS (SELECT DISTINCT lang, word, doc_id FROM tok), r AS (SELECT *, row_number() OVER (PARTITION BY lang, word ORDER BY doc_id) AS rn FROM e) SELECT lang, word, count(*) AS votes, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS episodes FROM r WHERE rn <= 3 GROUP BY ALL""")
def episode_votes(spark, d):
    rows = contexts.token_arrays(read(spark, d, "documents")).select("doc_id", "lang", F.explode(F.array_distinct("words")).alias("word"))
    found = memory.episode_votes(rows, ["lang", "word"], "doc_id")
    return found.select("lang", "word", "votes", F.array_join(F.transform("episodes", lambda e: e.cast("string")), ",").alias("episodes"))


@query("""WITH v AS (SELECT 'role' AS name, role AS value FROM conversations UNION ALL SELECT 'turn', turn::VARCHAR FROM conversations UNION ALL SELECT 'first', nullif(left(text, 1), '') FROM conversations UNION ALL SELECT 'length', (length(text) // 100)::VARCHAR FROM conversations),
c AS (SELECT name, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL) SELECT name, value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS place FROM c) WHERE place <= 12""")
def feedback_histograms(spark, d):
    values = {"role": F.col("role"), "turn": F.col("turn"), "first": F.nullif(F.substring("text", 1, 1), F.lit("")), "length": F.floor(F.length("text") / 100)}
    return memory.histograms(read(spark, d, "conversations"), values, 12).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {_TOK}, h AS (SELECT lang, word, cnt, ('0x' || substr(sha256(word), 1, 4))::BIGINT AS h0, ('0x' || substr(sha256(word), 5, 4))::BIGINT AS h1 FROM voc), a AS (SELECT h0, least(sum(cnt), 65535)::BIGINT AS n FROM h GROUP BY h0), b AS (SELECT h1, least(sum(cnt), 65535)::BIGINT AS n FROM h GROUP BY h1)
SELECT lang, word, cnt, least(a.n, b.n) AS estimate FROM h JOIN a USING (h0) JOIN b USING (h1)""")
def frequency_sketch(spark, d):
    words = _vocabulary(spark, d)
    found = memory.estimates(words, F.col("word"), memory.sketch(words, F.col("word"), F.col("cnt")))
    return found.select("lang", "word", "cnt", F.col("estimate").cast("long").alias("estimate"))


@query(f"""WITH {_TOK}, s AS (SELECT lang, word, CASE doc_id % 3 WHEN 0 THEN 0 ELSE doc_id % 3 END AS shard, count(*) AS support FROM tok GROUP BY ALL), base AS (SELECT *, 10 + length(word) AS threshold FROM s WHERE shard = 0), c AS (SELECT lang, word, sum(support)::BIGINT AS support FROM s GROUP BY ALL)
SELECT c.lang, c.word, support, coalesce(threshold, 25)::BIGINT AS threshold FROM c LEFT JOIN (SELECT lang, word, threshold FROM base) b ON b.lang = c.lang AND b.word = c.word""")
def composed_packages(spark, d):
    shards = contexts.token_arrays(read(spark, d, "documents")).select((F.col("doc_id") % 3).alias("shard"), "lang", F.explode("words").alias("word")).groupBy("shard", "lang", "word").agg(F.count("*").alias("support"))
    part = lambda k: shards.filter(F.col("shard") == k)
    found = memory.composed(part(0).withColumn("threshold", F.length("word") + 10), [part(1), part(2)], ["lang", "word"], 25)
    return found.select("lang", "word", "support", F.col("threshold").cast("long").alias("threshold"))


@query(f"""WITH {_TOK}, e AS (SELECT lang, word, doc_id % 4 AS generation, count(*) AS n FROM tok GROUP BY ALL), z AS (SELECT lang, word, max(doc_id % 4) AS deleted FROM tok WHERE pos = 0 GROUP BY ALL) SELECT e.lang, e.word, generation, n FROM e LEFT JOIN z ON z.lang = e.lang AND z.word = e.word WHERE deleted IS NULL OR deleted < generation""")
def tombstoned_entries(spark, d):
    rows = contexts.token_arrays(read(spark, d, "documents")).select((F.col("doc_id") % 4).alias("generation"), "lang", F.posexplode("words").alias("pos", "word"))
    entries = rows.groupBy("lang", "word", "generation").agg(F.count("*").alias("n"))
    return memory.without_tombstones(entries, rows.filter("pos = 0"), ["lang", "word"]).select("lang", "word", "generation", "n")


@query(f"""WITH {_SPOKEN}, a AS (SELECT word, count(*) AS n FROM said WHERE role = 'user' GROUP BY word), b AS (SELECT word, count(*) AS n FROM said WHERE role = 'assistant' GROUP BY word)
SELECT coalesce(a.word, b.word) AS word, coalesce(a.n, 0) AS base, coalesce(b.n, 0) AS live, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.word = b.word WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)""")
def learning_deltas(spark, d):
    counts = lambda role: _said(spark, d).filter(F.col("role") == role).groupBy("word").agg(F.count("*").alias("cnt"))
    return memory.deltas(counts("user"), counts("assistant"), ["word"])


@query(f"WITH {_TOK}, n AS (SELECT lang, word AS first, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS second, doc_id FROM tok) SELECT lang, first, second, count(*) AS n, count(DISTINCT doc_id) >= 2 AS ready FROM n WHERE second IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def reinforced_pairs(spark, d):
    after = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    rows = contexts.token_arrays(read(spark, d, "documents")).select("doc_id", "lang", F.explode(F.arrays_zip(F.col("words").alias("first"), after.alias("second"))).alias("p")).select("doc_id", "lang", "p.*").filter("second is not null")
    by_doc = rows.groupBy("lang", "first", "second", "doc_id").agg(F.count("*").alias("c"))
    return by_doc.groupBy("lang", "first", "second").agg(F.sum("c").alias("n"), (F.count("*") >= 2).alias("ready")).filter("n >= 3")


# Keys

_CH = "ch AS (SELECT conv_id, turn, unnest(regexp_split_to_array(coalesce(text, ''), '')) AS ch, unnest(range(length(coalesce(text, '')))) AS pos FROM conversations WHERE length(text) > 0)"


@query(rf"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(coalesce(text, ''), ' '), lambda v: v <> '') AS a FROM conversations), x AS (SELECT conv_id, turn, unnest(a) AS typed, unnest(range(1, len(a) + 1)) AS word_no FROM w)
SELECT conv_id, turn, word_no, typed, CASE WHEN length(regexp_replace(typed, '[^а-яА-ЯёЁ]', '', 'g')) > length(regexp_replace(typed, '[^A-Za-z]', '', 'g')) THEN translate(typed, '{_RU}', '{_US}') ELSE translate(typed, '{_US}', '{_RU}') END AS opposite, length(typed) AS n FROM x""")
def event_words(spark, d):
    events = keys.key_events(read(spark, d, "conversations"), ["conv_id", "turn"], "text")
    return keys.event_words(events, ["conv_id", "turn"]).select("conv_id", "turn", F.col("word_no").cast("long").alias("word_no"), "typed", "opposite", "n")


@query("""WITH b AS (SELECT user_id, event_type, count(*) AS taps FROM events WHERE event_id % 40 = 0 OR event_type = 'purchase' GROUP BY ALL) SELECT user_id, event_type, taps, CASE WHEN taps < 2 THEN NULL WHEN taps = 2 THEN 1 WHEN taps = 3 THEN 2 ELSE 3 END::BIGINT AS scope FROM b""")
def tap_scopes(spark, d):
    bursts = read(spark, d, "events").filter("event_id % 40 = 0 or event_type = 'purchase'").groupBy("user_id", "event_type").agg(F.count("*").alias("taps"))
    return bursts.select("user_id", "event_type", "taps", keys.tap_scope(F.col("taps")).cast("long").alias("scope"))


@query(f"""WITH {_TURNS}, o AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(x), length(y)) + 1), lambda k: right(x, k) = left(y, k))), 0) AS overlap FROM p) SELECT conv_id, turn, overlap, x || substr(y, overlap + 1) AS joined FROM o""")
def overlap_joined(spark, d):
    x, y = F.col("x"), F.col("y")
    return _turns(spark, d).select("conv_id", "turn", keys.overlap(x, y).cast("long").alias("overlap"), keys.joined(x, y).alias("joined"))


@query(f"""WITH {_COMMON}, known AS (SELECT DISTINCT word FROM lex), z AS (SELECT DISTINCT '(' || translate(word, '{_US}', '{_RU}') || '!' AS token, translate(word, '{_US}', '{_RU}') AS core, word AS other FROM voc WHERE length(word) >= 3 AND NOT regexp_matches(word, '[^a-z]'))
SELECT token, '(' || other || '!' AS replacement FROM z WHERE other IN (SELECT word FROM known) AND core NOT IN (SELECT word FROM known)""")
def layout_corrections(spark, d):
    typed = _vocabulary(spark, d).filter("length(word) >= 3 and not word rlike '[^a-z]'").select(F.concat(F.lit("("), X.to_russian(F.col("word")), F.lit("!")).alias("token")).distinct()
    return keys.layout_corrections(typed, _common(spark, d)).select("token", "replacement")


@query(f"""WITH {_COMMON}, h AS (SELECT rare.lang, rare.word, substr(rare.word, 1, i) AS a, substr(rare.word, i + 1) AS r FROM (SELECT lang, word, unnest(range(3, length(word) - 2)) AS i FROM rare WHERE length(word) >= 6) rare JOIN lex ON lex.lang = rare.lang AND lex.word = substr(rare.word, 1, i)),
two AS (SELECT h.lang, h.word, a || ' ' || r AS parts, 2 AS n FROM h JOIN lex ON lex.lang = h.lang AND lex.word = r), m AS (SELECT lang, word, a, r, unnest(range(3, length(r) - 2)) AS j FROM h WHERE length(r) >= 6),
three AS (SELECT m.lang, m.word, a || ' ' || substr(r, 1, j) || ' ' || substr(r, j + 1) AS parts, 3 AS n FROM m JOIN lex x ON x.lang = m.lang AND x.word = substr(r, 1, j) JOIN lex y ON y.lang = m.lang AND y.word = substr(r, j + 1))
SELECT * FROM two UNION ALL SELECT * FROM three""")
def glued_segments(spark, d):
    words = _vocabulary(spark, d)
    return keys.segmentations(words.filter("cnt < 5"), words.filter("cnt >= 5"))


# Corpora and reports

@query(f"""WITH {_TOK}, w AS (SELECT lang, word, cnt, length(word) AS n FROM voc WHERE length(word) >= 5), s AS (SELECT *, cnt % (n - 2) + 1 AS p, cnt % (n - 3) + 1 AS f FROM w),
x AS (SELECT *, substr(word, 1, f) || substr(word, f + 2, 1) || substr(word, f + 1, 1) || substr(word, f + 3) AS sw, least(f + 2, n - 2) AS g FROM s)
SELECT lang, word, substr(word, 1, p) || CASE WHEN substr(word, p + 1, 1) = 'a' THEN 'o' ELSE 'a' END || substr(word, p + 1) AS extra, substr(word, 1, p) || CASE WHEN substr(word, p + 1, 1) = 'a' THEN 'o' ELSE 'a' END || substr(word, p + 2) AS substitution,
left(word, n - 2 - cnt % 2) AS completion, substr(sw, 1, g) || CASE WHEN substr(sw, g + 1, 1) = 'e' THEN 'i' ELSE 'e' END || substr(sw, g + 2) AS composite FROM x""")
def damaged_letters(spark, d):
    words = _vocabulary(spark, d).filter("length(word) >= 5")
    made = corpus.damaged_letters(F.col("word"), F.col("cnt"), ("a", "o", "e", "i"))
    return words.select("lang", "word", *[c.alias(k) for k, c in made.items()])


_PARTS = "flatten([list_transform(range(1, length(word) + 2), lambda i: substr('^' || word || '$', i, 2)), list_transform(range(1, length(word) + 1), lambda i: substr('^' || word || '$', i, 3)), list_transform(range(1, length(word)), lambda i: substr('^' || word || '$', i, 4))])"


@query(f"""WITH {_TOK}, side AS (SELECT lang, word, ('0x' || substr(sha256(word), 1, 2))::BIGINT < 26 AS held FROM voc WHERE lang IN ('en', 'de')), f AS (SELECT lang, feature, count(*) AS n FROM (SELECT lang, unnest(list_distinct({_PARTS})) AS feature FROM side WHERE NOT held) GROUP BY ALL),
h AS (SELECT DISTINCT word FROM side WHERE held), o AS (SELECT word, unnest({_PARTS}) AS feature FROM h), s AS (SELECT word, lang, sum(n)::BIGINT AS total FROM o JOIN f USING (feature) GROUP BY ALL), z AS (SELECT side.lang, side.word, coalesce(max(total) FILTER (s.lang = 'en'), 0) AS en, coalesce(max(total) FILTER (s.lang = 'de'), 0) AS de FROM side LEFT JOIN s ON s.word = side.word WHERE held GROUP BY ALL)
SELECT lang, count(*) AS total, count(*) FILTER (en + de > 0 AND lang = CASE WHEN de >= en THEN 'de' ELSE 'en' END) AS correct, count(*) FILTER (en + de > 0 AND lang <> CASE WHEN de >= en THEN 'de' ELSE 'en' END) AS wrong, count(*) FILTER (en + de = 0) AS abstain FROM z GROUP BY lang""")
def fragment_proof(spark, d):
    """Held-out words told by the fragments of two languages' other words."""
    side = _vocabulary(spark, d).filter("lang in ('en', 'de')").select("lang", "word", corpus.held_out(F.col("word")).alias("held"))
    w = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = lambda n: F.transform(F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(w, i, F.lit(n)))
    features = side.filter("not held").select("lang", F.explode(F.array_distinct(F.concat(grams(2), grams(3), grams(4)))).alias("feature")).groupBy("lang", "feature").agg(F.count("*").alias("n"))
    held = side.filter("held")
    scores = corpus.fragment_scores(held.select("word").distinct(), features).groupBy("word").agg(*[F.coalesce(F.max(F.when(F.col("lang") == v, F.col("total"))), F.lit(0)).alias(v) for v in ("en", "de")])
    told = held.join(scores, "word", "left").withColumn("sum", F.coalesce(F.col("en") + F.col("de"), F.lit(0))).withColumn("said", F.when(F.col("de") >= F.col("en"), "de").otherwise("en"))
    return told.groupBy("lang").agg(F.count("*").alias("total"), F.count_if((F.col("sum") > 0) & (F.col("said") == F.col("lang"))).alias("correct"), F.count_if((F.col("sum") > 0) & (F.col("said") != F.col("lang"))).alias("wrong"), F.count_if(F.col("sum") == 0).alias("abstain"))


@query(f"""WITH {_TOK}, r AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY word) AS i, count(*) OVER (PARTITION BY lang) AS size FROM voc), s AS (SELECT lang, word, unnest(range(i - 1, 240, size)) AS slot FROM r WHERE i <= 240) SELECT lang, slot // 12 AS line, string_agg(word, ' ' ORDER BY slot) AS text FROM s GROUP BY ALL""")
def cycled_lines(spark, d):
    words = _vocabulary(spark, d).select("lang", "word")
    placed = rank.ordinal(words, ["lang"], F.substring("word", 1, 2), ["word"], "i").join(words.groupBy("lang").agg(F.count("*").alias("size")), "lang")
    return corpus.cycled_lines(placed.withColumn("i", F.col("i").cast("long")), 20).select("lang", F.col("line").cast("long").alias("line"), "text")


@query(rf"""WITH t AS (SELECT lang, '^^' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || '$' AS s FROM documents WHERE text IS NOT NULL), g AS (SELECT lang, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS gram FROM t) SELECT lang, gram, count(*) AS cnt FROM g GROUP BY ALL""")
def text_trigrams(spark, d):
    # By an array of characters: a substring's cost grows with its place.
    s = X.chars(F.concat(F.lit("^^"), F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")), F.lit("$")))
    rows = read(spark, d, "documents").filter("text is not null").select("lang", s.alias("s")).filter(F.size("s") > 2)
    grams = F.transform(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 2).alias("a"), F.slice("s", F.lit(2), F.size("s") - 2).alias("b"), F.slice("s", F.lit(3), F.size("s") - 2).alias("c")), lambda p: F.concat(p["a"], p["b"], p["c"]))
    return rows.select("lang", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("cnt"))


_CLASS = f"""CASE WHEN {_SWAPPED} OR ({_MOVED}) THEN 'swap' WHEN {_RUNS} THEN 'repeat' WHEN {_LESS.format('damaged', 'word')} THEN 'extra' WHEN {_LESS.format('word', 'damaged')} THEN 'missing' ELSE 'other' END"""


@query(f"""WITH {_TOK}, {_DAMAGED}, c AS (SELECT *, {_CLASS} AS rule FROM d WHERE way <> 'none'), k AS (SELECT unnest(['swap', 'repeat', 'extra', 'missing', 'other']) AS cell)
SELECT cell, count(*) AS cases, count(*) FILTER (rule <> cell) AS covered, count(*) FILTER (rule <> cell) - count(*) AS delta FROM c, k GROUP BY cell""")
def rule_ablation(spark, d):
    """How many damaged words each rule alone stands for: coverage with it left out, against all."""
    a, b = F.col("damaged"), F.col("word")
    named = F.create_map(*map(F.lit, ("adjacent-transposition", "swap", "repeated-letter", "repeat", "extra-letter", "extra", "missing-letter", "missing")))
    counts = _damaged(spark, d).filter("way != 'none'").select(F.coalesce(F.try_element_at(named, S.typo_class(a, b, F.lit("unknown"))), F.lit("other")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*map(F.lit, ("swap", "repeat", "extra", "missing", "other"))))
    out = counts.select("rule", "n", cells.alias("cell")).groupBy("cell").agg(F.sum("n").alias("cases"), F.sum(F.when(F.col("rule") != F.col("cell"), F.col("n")).otherwise(0)).alias("covered"))
    return out.withColumn("delta", F.col("covered") - F.col("cases"))


@query(f"""WITH {_COMMON}, a AS (SELECT DISTINCT rare.lang, rare.word FROM (SELECT lang, word, unnest(list_transform(range(1, length(word)), lambda i: substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2))) AS c FROM rare) rare JOIN lex ON lex.lang = rare.lang AND lex.word = c AND c <> rare.word),
b AS (SELECT DISTINCT rare.lang, rare.word FROM (SELECT lang, word, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS c FROM rare) rare JOIN lex ON lex.lang = rare.lang AND lex.word = c)
SELECT coalesce(a.lang, b.lang) AS lang, count(*) FILTER (b.word IS NULL) AS only_first, count(*) FILTER (a.word IS NULL) AS only_second, count(*) FILTER (a.word IS NOT NULL AND b.word IS NOT NULL) AS both FROM a FULL JOIN b ON a.lang = b.lang AND a.word = b.word GROUP BY 1""")
def route_compare(spark, d):
    """Two candidate routes over the same words: where only one has any, and where both do."""
    words = _vocabulary(spark, d)
    rare, known = words.filter("cnt < 5"), words.filter("cnt >= 5")
    side = lambda f, k: f(rare, known).select("lang", "word").distinct().withColumn(k, F.lit(True))
    both = side(candidates.transpositions, "a").join(side(candidates.extra_letters, "b"), ["lang", "word"], "full")
    return both.groupBy("lang").agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


@query(f"""WITH {_TOK}, {_NEAR}, nx AS (SELECT lang, word AS first, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM tok), c AS (SELECT lang, first, second, count(*) AS support FROM nx WHERE second IS NOT NULL GROUP BY ALL),
m AS (SELECT c.lang, c.first AS observed, c.second, near.replacement AS candidate, k.support FROM c JOIN near ON near.lang = c.lang AND near.original = c.first JOIN c k ON k.lang = c.lang AND k.first = near.replacement AND k.second = c.second)
SELECT lang, observed, second, candidate, support FROM m QUALIFY row_number() OVER (PARTITION BY lang, observed, second ORDER BY support DESC, candidate) = 1""")
def previous_tokens(spark, d):
    """For a rare token before another: the near, frequent word that comes before it most often."""
    from pyspark.sql import Window

    counts = contexts.pairs(read(spark, d, "documents")).groupBy("lang", "first", "second").agg(F.count("*").alias("support"))
    near = _near(spark, d).select("lang", F.col("original").alias("first"), F.col("replacement").alias("candidate"))
    asked = counts.drop("support").join(near, ["lang", "first"]).withColumnRenamed("first", "observed")
    found = asked.join(counts.withColumnRenamed("first", "candidate"), ["lang", "candidate", "second"])
    place = F.row_number().over(Window.partitionBy("lang", "observed", "second").orderBy(F.desc("support"), "candidate"))
    return found.withColumn("place", place).filter("place = 1").select("lang", "observed", "second", "candidate", "support")
