"""Queries of surfaces, scores and edits; they join those of keyloom.plans.queries when this module is imported."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyloom.functions import distance, surface as S, text as X
from keyloom.operators import candidates, contexts, decide, rank, safety, score
from keyloom.plans.queries import _BYTE, _COMMON, _TOK, _WIDE, _common, _vocabulary, query, read

_W, _N = S.WS, S.NOT_WS
_TOKENS = rf"tokens AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '{_W}+')) AS token FROM documents)"


def _distinct_tokens(spark, d):
    return read(spark, d, "documents").select(F.explode(F.split("text", _W + "+")).alias("token")).distinct()


@query(rf"""SELECT doc_id, length(text) - length(regexp_replace(text, '{_W}+\z', '')) AS trailing, nullif(regexp_extract(text, '({_N}+)\z', 1), '') AS last_token, nullif(regexp_extract(text, '(\p{{L}}+)[^\p{{L}}]*\z', 1), '') AS last_letters,
2 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) < greatest(length(regexp_replace(text, '{_W}', '', 'g')), 1) AS low_alpha FROM documents""")
def text_tails(spark, d):
    c = F.col("text")
    return read(spark, d, "documents").select("doc_id", S.trailing_whitespace(c).cast("long").alias("trailing"), S.last_ws_token(c).alias("last_token"), S.last_alphabetic_token(c).alias("last_letters"), S.alpha_is_low(c).alias("low_alpha"))


@query(rf"""WITH {_TOKENS}, x AS (SELECT token, lower(trim(token)) AS low, regexp_replace(regexp_replace(trim(token), '^[^\p{{L}}-]+', ''), '[^\p{{L}}-]+\z', '') AS bare, regexp_replace(token, '[^A-Za-z]', '', 'g') AS al FROM tokens)
SELECT token, regexp_matches(token, '^[а-яА-ЯёЁ-]+\z') AS cyrillic, regexp_matches(token, '^[а-яА-ЯёЁ]+\z') AS cyrillic_letters, regexp_replace(regexp_replace(token, '^[!-/:-@\[-`{{-~«»“”„…]+', ''), '[!-/:-@\[-`{{-~«»“”„…]+\z', '') AS context,
CASE WHEN regexp_matches(low, '^[\p{{L}}''-]+\z') AND length(low) <= 24 THEN low END AS surface, lower(regexp_replace(regexp_replace(trim(token), '^[!,.?;:]+', ''), '[!,.?;:]+\z', '')) AS lexical, CASE WHEN regexp_matches(bare, '\p{{L}}') THEN lower(bare) ELSE '' END AS memory,
trim(regexp_replace(regexp_replace(translate(lower(token), 'ё', 'е'), '[^\p{{L}}\p{{N}}_\t-\r\x{{85}}\p{{Z}}-]+', '', 'g'), '{_W}+', ' ', 'g')) AS model,
regexp_matches(token, '[A-Za-z]') AND NOT regexp_matches(token, '[^\x00-\x7F]') AND (regexp_matches(token, '[A-Za-z][^A-Za-z]*[A-Za-z].*\.[A-Za-z]{{2,4}}\z') OR regexp_matches(token, '[@/\\]') OR regexp_matches(al, '^[A-Z]{{2,4}}\z') OR (length(al) >= 4 AND regexp_matches(al, '[a-z]') AND regexp_matches(al, '^.+[A-Z]'))) AS protected FROM x""")
def token_surfaces(spark, d):
    c = F.col("token")
    return _distinct_tokens(spark, d).select("token", S.is_cyrillic_word(c).alias("cyrillic"), S.is_cyrillic_letters(c).alias("cyrillic_letters"), S.context_token(c).alias("context"), S.normal_surface(c).alias("surface"), S.lexical_surface(c).alias("lexical"), S.memory_word(c).alias("memory"), S.model_normal(c).alias("model"), S.protected_ascii(c).alias("protected"))


@query(rf"""WITH t AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '{_W}+'), lambda x: regexp_replace(regexp_replace(trim(x), '^[^\p{{L}}-]+', ''), '[^\p{{L}}-]+\z', '')) AS a FROM documents),
m AS (SELECT doc_id, list_transform(list_filter(a, lambda x: regexp_matches(x, '\p{{L}}')), lambda x: lower(x)) AS w FROM t)
SELECT doc_id, len(w) AS n, array_to_string(w[greatest(len(w) - 4, 1) : len(w)], ' ') AS recent, CASE WHEN len(w) > 0 THEN w[-1] END AS last_word, CASE WHEN len(w) > 0 THEN array_to_string(w[greatest(len(w) - 5, 1) : len(w) - 1], ' ') END AS before FROM m""")
def memory_contexts(spark, d):
    words, both = S.memory_words(F.col("text")), S.context_and_last(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.array_join(S.recent_words(words), " ").alias("recent"), both["word"].alias("last_word"), F.array_join(both["context"], " ").alias("before"))


_TURNS = "p AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') AS x, coalesce(b.text, '') AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def _turns(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return c.select("conv_id", "turn", F.col("text").alias("x")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y")), ["conv_id", "turn"])


def _memory(c: str) -> str:
    bare = rf"list_transform(regexp_split_to_array({c}, '{_W}+'), lambda v: regexp_replace(regexp_replace(trim(v), '^[^\p{{L}}-]+', ''), '[^\p{{L}}-]+\z', ''))"
    return rf"list_transform(list_filter({bare}, lambda v: regexp_matches(v, '\p{{L}}')), lambda v: lower(v))"


@query(rf"""WITH {_TURNS}, m AS (SELECT conv_id, turn, {_memory('x')} AS a, {_memory('y')} AS b FROM p),
f AS (SELECT *, list_filter(range(1, len(b) + 1), lambda i: i > len(a) OR a[i] <> b[i]) AS differ FROM m), g AS (SELECT *, CASE WHEN len(differ) = 0 AND len(b) > 0 THEN [len(b)] ELSE differ END AS changed FROM f),
h AS (SELECT *, least(CASE WHEN len(changed) > 0 THEN changed[1] - 1 ELSE greatest(len(a) - 1, 0) END, len(a)) AS start FROM g)
SELECT conv_id, turn, len(changed) AS changed, CASE WHEN start > 0 THEN array_to_string(a[greatest(start - 4, 1) : start], ' ') ELSE '' END AS context FROM h""")
def transition_contexts(spark, d):
    x, y = F.col("x"), F.col("y")
    return _turns(spark, d).select("conv_id", "turn", F.size(S.changed_targets(S.memory_words(x), S.memory_words(y))).cast("long").alias("changed"), F.array_join(S.transition_context(x, y), " ").alias("context"))


# Words damaged in known ways, and what the geometry of the edit says
_DAMAGED = r"""lex5 AS (SELECT lang, word, length(word) AS n FROM voc WHERE cnt >= 5 AND length(word) >= 5),
d AS (SELECT lang, word, substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4) AS damaged, 'swap' AS way FROM lex5
UNION ALL SELECT lang, word, substr(word, 1, 1) || substr(word, 3, n - 3) || substr(word, 2, 1) || substr(word, n), 'move' FROM lex5 UNION ALL SELECT lang, word, substr(word, 1, 2) || substr(word, 4), 'drop' FROM lex5
UNION ALL SELECT lang, word, substr(word, 1, 3) || substr(word, 3), 'double' FROM lex5 UNION ALL SELECT lang, word, substr(word, 1, 2) || '#' || substr(word, 3), 'add' FROM lex5 UNION ALL SELECT lang, word, substr(word, 1, 2) || '#' || substr(word, 4), 'change' FROM lex5 UNION ALL SELECT lang, word, word, 'none' FROM lex5)"""


def _damaged(spark, d):
    ways = {
        "swap": "substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4)", "move": "substr(word, 1, 1) || substr(word, 3, length(word) - 3) || substr(word, 2, 1) || substr(word, length(word))",
        "drop": "substr(word, 1, 2) || substr(word, 4)", "double": "substr(word, 1, 3) || substr(word, 3)", "add": "substr(word, 1, 2) || '#' || substr(word, 3)", "change": "substr(word, 1, 2) || '#' || substr(word, 4)", "none": "word",
    }
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("way"), F.expr(v).alias("damaged")) for k, v in ways.items()]))
    return _vocabulary(spark, d).filter("cnt >= 5 and length(word) >= 5").select("lang", "word", made.alias("m")).select("lang", "word", "m.way", "m.damaged")


_SWAPPED = "list_contains(list_transform(range(1, length(damaged)), lambda i: substr(damaged, 1, i - 1) || substr(damaged, i + 1, 1) || substr(damaged, i, 1) || substr(damaged, i + 2)), word) AND damaged <> word"
_LESS = "list_contains(list_transform(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1)), {1})"
_MOVED = "length(word) >= 5 AND length(word) = length(damaged) AND word <> damaged AND left(word, 1) = left(damaged, 1) AND right(word, 1) = right(damaged, 1) AND list_contains(flatten(list_transform(range(2, length(damaged)), lambda i: list_transform(range(1, length(damaged) - 1), lambda j: substr(substr(damaged, 1, i - 1) || substr(damaged, i + 1), 1, j) || substr(damaged, i, 1) || substr(substr(damaged, 1, i - 1) || substr(damaged, i + 1), j + 1)))), word)"
_RUNS = "list_contains(list_transform(list_filter(range(1, length(damaged)), lambda i: substr(damaged, i, 1) = substr(damaged, i + 1, 1)), lambda i: substr(damaged, 1, i) || substr(damaged, i + 2)), word)"


@query(f"""WITH {_TOK}, {_DAMAGED}, g AS (SELECT *, {_SWAPPED} AS swapped, {_MOVED} AS moved, {_LESS.format('damaged', 'word')} AS less, {_LESS.format('word', 'damaged')} AS more, {_RUNS} AS run FROM d)
SELECT lang, word, way, damaged, moved, CASE WHEN swapped THEN 4 WHEN more THEN 2 ELSE 0 END AS priority, CASE WHEN damaged = word THEN 'unknown' WHEN swapped OR moved THEN 'adjacent-transposition' WHEN run THEN 'repeated-letter' WHEN less THEN 'extra-letter' WHEN more THEN 'missing-letter'
 WHEN length(word) = length(damaged) AND len(list_filter(range(1, length(word) + 1), lambda i: substr(word, i, 1) <> substr(damaged, i, 1))) = 1 THEN 'letter-substitution' ELSE 'composite-typo' END AS class FROM g""")
def edit_geometry(spark, d):
    a, b = F.col("damaged"), F.col("word")
    return _damaged(spark, d).select("lang", "word", "way", "damaged", S.is_internal_move(a, b).alias("moved"), S.damage_priority(a, b).alias("priority"), S.typo_class(a, b, F.lit("unknown")).alias("class"))


@query()
def sparse_omissions(spark, d):
    """Words less their third and fifth letters: how many scattered omissions lead back (tests hold it against brute force)."""
    words = _vocabulary(spark, d).filter("cnt >= 5 and length(word) >= 7").select("lang", "word", F.expr("substr(word, 1, 2) || substr(word, 4, 1) || substr(word, 6)").alias("damaged"))
    return words.select("lang", "word", "damaged", S.sparse_omissions(F.col("damaged"), F.col("word")).alias("omissions"))


@query(f"""WITH {_TOK}, {_DAMAGED} SELECT lang, word, way, damaged, round(1 - levenshtein(translate(regexp_replace(damaged, '#', ''), '{_WIDE}', '{_BYTE}'), translate(word, '{_WIDE}', '{_BYTE}')) / greatest(length(regexp_replace(damaged, '#', '')), length(word)), 6) AS similarity FROM d WHERE NOT contains(word, '-')""")
def normalized_similarity(spark, d):
    return _damaged(spark, d).filter(~F.col("word").contains("-")).select("lang", "word", "way", "damaged", F.round(S.similarity(F.col("damaged"), F.col("word")), 6).alias("similarity"))


# Scores

_LN = "ln(cnt + 1)"


@query(f"""WITH {_TOK} SELECT lang, word, round(least({_LN} * 0.052, 0.30), 6) AS accepted, round(least({_LN} * 0.040, 0.26), 6) AS rejected, round(least({_LN} * 0.050, 0.32), 6) AS attraction, round(least({_LN} * 0.060, 0.38), 6) AS repulsion, round(least(0.08 + least({_LN} * 0.036, 0.22), 0.26), 6) AS local FROM voc""")
def usage_priors(spark, d):
    from keyloom.operators import journal

    c = F.col("cnt")
    local = score.local_prior(F.lit(True), journal.prior_from_count(c))
    return _vocabulary(spark, d).select("lang", "word", *[F.round(f, 6).alias(n) for n, f in (("accepted", score.accepted_prior(c)), ("rejected", score.rejected_prior(c)), ("attraction", score.attraction(c)), ("repulsion", score.repulsion(c)), ("local", local))])


@query(f"""WITH {_TOK}, r AS (SELECT lang, word, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) - 1 AS rank FROM voc)
SELECT lang, word, rank, CASE WHEN rank < 1000 THEN 640 WHEN rank < 5000 THEN 500 WHEN rank < 20000 THEN 340 WHEN rank < 60000 THEN 180 ELSE 80 END AS boost, CASE WHEN rank < 1000 THEN 6 WHEN rank < 10000 THEN 3 WHEN rank < 50000 THEN 1 ELSE 0 END::DOUBLE AS bonus,
CASE WHEN rank < 1000 THEN 640 WHEN rank < 5000 THEN 500 WHEN rank < 20000 THEN 340 WHEN rank < 60000 THEN 180 ELSE 80 END + least(cnt, 128) + 360 - least(length(word), 16) * 10 AS completion FROM r""")
def rank_boosts(spark, d):
    placed = rank.ordinal(_vocabulary(spark, d), ["lang"], -F.col("cnt"), ["word"], "place").withColumn("rank", (F.col("place") - 1).cast("long"))
    r = F.col("rank")
    return placed.select("lang", "word", "rank", score.corpus_rank_boost(r).alias("boost"), decide.rank_bonus(r).alias("bonus"), score.completion_score(r, F.col("cnt"), F.lit(0), F.length("word")).cast("long").alias("completion"))


@query(f"""WITH {_TOK}, c AS (SELECT doc_id, pos, word, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ctx FROM tok), k AS (SELECT doc_id, pos, unnest(range(1, least(5, len(ctx)) + 1)) AS n, ctx, word FROM c),
j AS (SELECT doc_id, pos, n, array_to_string(ctx[len(ctx) - n + 1 : len(ctx)], ' ') AS key, word FROM k), m AS (SELECT key, word, count(*) AS cnt FROM j GROUP BY ALL), last AS (SELECT doc_id, max(pos) AS pos FROM tok GROUP BY doc_id)
SELECT j.doc_id, j.word, round(least(sum(least(ln(m.cnt + 1) * (0.02 + 0.01 * j.n), 0.18)), 0.34), 6) AS prior FROM j JOIN last USING (doc_id, pos) JOIN m USING (key, word) GROUP BY ALL""")
def context_priors(spark, d):
    docs = read(spark, d, "documents")
    tail = F.reverse(F.slice(F.reverse("words"), F.lit(1), F.lit(6)))
    last = contexts.token_arrays(docs).withColumn("t", tail).filter(F.size("t") > 1)
    keys = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("t", F.size("t") - n, n), " ").alias("key")))
    asked = last.select("doc_id", F.element_at("t", -1).alias("word"), F.explode(keys).alias("k")).select("doc_id", "word", "k.n", "k.key")
    return score.context_prior(asked.join(contexts.counts_of(docs, asked), ["key", "word"]), ["doc_id", "word"]).withColumn("prior", F.round("prior", 6))


_RANKED = "ranked AS (SELECT lang, word, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) - 1 AS rank FROM voc)"


@query(f"""WITH {_COMMON}, {_RANKED}, w AS (SELECT lang, word AS original, unnest(list_transform(range(1, length(word)), lambda i: substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2))) AS replacement FROM rare),
s AS (SELECT DISTINCT w.lang, original, replacement, 'typo' AS family, 1 AS distance FROM w JOIN lex ON lex.lang = w.lang AND lex.word = replacement WHERE original <> replacement),
g AS (SELECT rare.lang, rare.word AS original, a.word || ' ' || b.word AS replacement, 'boundary' AS family, 1 AS distance, b.word AS last FROM (SELECT lang, word, unnest(range(3, length(word) - 2)) AS i FROM rare WHERE length(word) >= 6) rare JOIN lex a ON a.lang = rare.lang AND a.word = substr(rare.word, 1, i) JOIN lex b ON b.lang = rare.lang AND b.word = substr(rare.word, i + 1)),
z AS (SELECT lang, original, replacement, family, distance, replacement AS last FROM s UNION ALL SELECT * FROM g)
SELECT u.lang, original, replacement, family, round(CASE family WHEN 'typo' THEN 78 ELSE 84 END + CASE family WHEN 'boundary' THEN 4 ELSE 0 END + CASE WHEN r.cnt >= 50 THEN 8 ELSE 0 END + CASE WHEN rank < 1000 THEN 6 WHEN rank < 10000 THEN 3 WHEN rank < 50000 THEN 1 ELSE 0 END + 0.1 - 4 * distance / greatest(length(original), length(replacement)) - 0.25, 6) AS total
FROM z u JOIN ranked r ON r.lang = u.lang AND r.word = last""")
def candidate_scores(spark, d):
    words = _vocabulary(spark, d)
    rare, known = words.filter("cnt < 5"), words.filter("cnt >= 5")
    swaps = candidates.transpositions(rare, known).select("lang", F.col("word").alias("original"), F.col("candidate").alias("replacement"), F.lit("typo").alias("family"), F.col("candidate").alias("last"))
    cuts = candidates.glued(rare, known).select("lang", F.col("word").alias("original"), F.concat_ws(" ", "left", "right").alias("replacement"), F.lit("boundary").alias("family"), F.col("right").alias("last"))
    ranks = rank.ordinal(words, ["lang"], -F.col("cnt"), ["word"], "place").select("lang", F.col("word").alias("last"), "cnt", (F.col("place") - 1).alias("rank"))
    pairs = swaps.unionByName(cuts).join(ranks, ["lang", "last"])
    found = score.scored(pairs, F.lit(1), F.col("rank"), F.col("cnt") >= 50, F.lit(""), F.col("family"), F.lit(10), F.lit(0.0))
    return found.select("lang", "original", "replacement", "family", F.round("total", 6).alias("total"))


_NEAR = f"""k AS (SELECT DISTINCT lang, word, cnt, unnest(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS key FROM voc),
n AS (SELECT DISTINCT a.lang, a.word AS original, b.word AS replacement, b.cnt FROM k a JOIN k b ON a.lang = b.lang AND a.key = b.key AND a.word <> b.word WHERE a.cnt < 5 AND b.cnt >= 5),
near AS (SELECT * FROM n WHERE abs(length(original) - length(replacement)) <= 1 AND damerau_levenshtein(translate(original, '{_WIDE}', '{_BYTE}'), translate(replacement, '{_WIDE}', '{_BYTE}')) = 1)"""
_RUN_OF = "list_contains(list_transform(list_filter(range(1, length(original)), lambda i: substr(original, i, 1) = substr(original, i + 1, 1)), lambda i: substr(original, 1, i) || substr(original, i + 2)), replacement)"


def _near(spark, d):
    words = _vocabulary(spark, d)
    found = candidates.neighbours(words.filter("cnt < 5"), words.filter("cnt >= 5"))
    return found.join(words.select("lang", F.col("word").alias("candidate"), "cnt"), ["lang", "candidate"]).select("lang", F.col("word").alias("original"), F.col("candidate").alias("replacement"), "cnt")


@query(f"""WITH {_TOK}, {_NEAR}, c AS (SELECT *, greatest(length(original), length(replacement)) AS m, CASE WHEN length(original) > length(replacement) THEN 0.74 WHEN length(original) < length(replacement) THEN 0.78
 WHEN len(list_filter(range(1, length(original) + 1), lambda i: substr(original, i, 1) <> substr(replacement, i, 1))) = 1 THEN 0.68 ELSE 0.82 END AS least FROM near),
p AS (SELECT *, greatest(1 - 1 / m, least) AS likelihood, least(least(ln(cnt + 1) * 0.036, 0.22) + least(ln(cnt + 1) * 0.052, 0.30), 0.36) AS usage FROM c)
SELECT lang, original, replacement, round(likelihood, 6) AS likelihood, round(usage, 6) AS usage, round(least(likelihood * 0.55 + usage + 0.16, 1), 6) AS posterior FROM p""")
def bayes_scores(spark, d):
    from keyloom.operators import journal

    a, b, one, no = F.col("original"), F.col("replacement"), F.lit(1), F.lit(False)
    likely = score.likelihood(F.col("error"), no, one, F.greatest(F.length(a), F.length(b)))
    usage = F.least(journal.prior_from_count(F.col("cnt")) + score.accepted_prior(F.col("cnt")), F.lit(0.36))
    against = score.risk(a, b, one, no, F.lit(True), no, F.lit(True))
    pairs = _near(spark, d).withColumn("error", S.typo_class(a, b, F.lit("unknown"))).withColumn("likelihood", likely).withColumn("usage", usage).withColumn("posterior", score.posterior(F.col("likelihood"), F.col("usage"), F.lit(0.0), F.lit(0.16), F.lit(0.0), against))
    return pairs.select("lang", "original", "replacement", *[F.round(c, 6).alias(c) for c in ("likelihood", "usage", "posterior")])


@query(f"""WITH {_TOK}, {_NEAR}, r AS (SELECT *, row_number() OVER w AS place, lead(cnt) OVER w AS after, count(*) OVER (PARTITION BY lang, original) AS tied FROM near WINDOW w AS (PARTITION BY lang, original ORDER BY cnt DESC, replacement))
SELECT lang, original, tied, replacement AS winner, cnt - after AS margin FROM r WHERE place = 1 AND tied BETWEEN 2 AND 32 AND cnt > after""")
def tied_winners(spark, d):
    return score.tied_winner(_near(spark, d).withColumn("distance", F.lit(1)), ["lang", "original"], "distance", "cnt", "replacement")


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(least(round(v::DOUBLE * 127), 127), -127)) AS e FROM embeddings), p AS (SELECT a.vec_id, list_dot_product(a.e, b.e) AS dot, sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) AS len FROM q a JOIN q b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CASE WHEN len = 0 THEN 0 ELSE greatest(least(round((dot / len + 1) * 500), 1000), 0) END::INT AS coherence FROM p""")
def phase_coherence(spark, d):
    q = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: decide.quantized(v.cast("double"))).alias("e"))
    pairs = q.join(q.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("other")), "vec_id")
    return pairs.select("vec_id", score.coherence_milli(F.col("e"), F.col("other")).alias("coherence"))


# Edits

_PLAN = r"""e AS (SELECT conv_id, turn, coalesce(text, '') AS x, CASE turn % 3 WHEN 0 THEN coalesce(text, '') || 'x' WHEN 1 THEN regexp_replace(coalesce(text, ''), ' ', '') ELSE 'so ' || coalesce(text, '') END AS y, CASE (conv_id + turn) % 5 WHEN 0 THEN 'boundary' WHEN 1 THEN 'manual' WHEN 2 THEN 'layout' WHEN 3 THEN 'context' END AS proof FROM conversations),
l AS (SELECT *, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: left(x, i) = left(y, i))) AS lead_, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: right(x, i) = right(y, i))) AS tail0 FROM e),
t AS (SELECT *, least(tail0, least(length(x), length(y)) - lead_) AS tail FROM l), c AS (SELECT *, substr(x, lead_ + 1, length(x) - lead_ - tail) AS deleted, substr(y, lead_ + 1, length(y) - lead_ - tail) AS ins FROM t)"""


def _planned(spark, d):
    x = F.coalesce("text", F.lit(""))
    y = F.when(F.col("turn") % 3 == 0, F.concat(x, F.lit("x"))).when(F.col("turn") % 3 == 1, F.regexp_replace(x, "^([^ ]*) ", "$1")).otherwise(F.concat(F.lit("so "), x))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    proof = F.when(kind == 0, "boundary").when(kind == 1, "manual").when(kind == 2, "layout").when(kind == 3, "context")
    made = read(spark, d, "conversations").select("conv_id", "turn", x.alias("x"), y.alias("y"), proof.alias("proof"))
    return made.withColumn("e", distance.whole_text_edit("x", "y")).select("*", "e.*").drop("e")


def _count(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{_W}+'), lambda v: v <> ''))"


@query(rf"""WITH {_PLAN}, f AS (SELECT *, lead_ AS s, lead_ + length(deleted) AS t_, {_count('x')} AS nx, {_count('y')} AS ny FROM c),
g AS (SELECT *, s > 0 AND t_ < length(x) AND regexp_matches(substr(x, s, 1), '{_N}') AND regexp_matches(substr(x, t_ + 1, 1), '{_N}') AS joined, length(x) - length(regexp_replace(x, '{_W}+\z', '')) AS blank FROM f),
h AS (SELECT *, nx <> ny OR regexp_matches(regexp_replace(regexp_replace(deleted, '^{_W}+', ''), '{_W}+\z', ''), '{_W}') OR regexp_matches(regexp_replace(regexp_replace(ins, '^{_W}+', ''), '{_W}+\z', ''), '{_W}') OR (regexp_matches(ins, '{_W}') AND joined) AS boundary, (deleted <> '' OR ins <> '') AND tail > blank AS inside, coalesce(proof IN ('boundary', 'manual'), false) AS backed, coalesce(proof = 'layout', false) AS lay FROM g)
SELECT conv_id, turn, deleted, ins AS inserted, true AS "right", boundary, CASE WHEN s = t_ THEN joined::INT ELSE {_count('deleted')} END AS touched, CASE WHEN nx > 1 AND NOT backed THEN 'unsafe_multiword_autocorrect_scope' WHEN inside AND NOT (backed OR lay) THEN 'unsafe_middle_suffix_autocorrect_plan' WHEN boundary AND NOT (backed OR lay) THEN 'unsafe_boundary_edit_without_proof' ELSE 'safe_edit_plan' END AS reason FROM h""")
def edit_safety(spark, d):
    r = safety.report(F.col("x"), F.col("y"), F.col("move_left"), F.col("backspaces"), F.col("insert"), F.col("proof"))
    found = _planned(spark, d).withColumn("r", r)
    return found.select("conv_id", "turn", "r.deleted", F.col("insert").alias("inserted"), "r.right", "r.boundary", F.col("r.touched").cast("long").alias("touched"), "r.reason")
