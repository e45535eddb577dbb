"""Queries over files that they write first: lines, lexicons, dictionaries, cases, journals; they join the others on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import distance, text as X
from keyloom.operators import decide
from keyloom.plans.edits import _damaged, _DAMAGED
from keyloom.plans.queries import _BYTE, _TOK, _WIDE, _vocabulary, query, read
from keyloom.sources import text as sources


def _texts(spark, df, tag):
    """df(value) written as text files; their path."""
    path = sources.shared_path(spark, tag)
    df.write.text(path)
    return path


_ENGLISH = "SELECT DISTINCT word FROM voc WHERE lang = 'en' AND length(word) >= 3 AND regexp_matches(word, '^[a-z-]+$')"


def _list(spark, d):
    """English words with a comment, blank lines and stray blanks between them."""
    word = F.col("word")
    rows = F.explode(F.array(F.concat(F.lit("  "), F.upper(word), F.lit(" ")), F.lit(""), F.concat(F.lit("# "), word), word))
    return _texts(spark, _vocabulary(spark, d).filter("lang = 'en' and not contains(word, 'ß')").select(rows.alias("value")), "words")


@query(f"WITH {_TOK} {_ENGLISH}")
def plain_word_list(spark, d):
    return sources.plain_words(spark, _list(spark, d), "en", 3)


@query(f"WITH {_TOK}, e AS (SELECT word FROM voc WHERE lang = 'en' AND NOT contains(word, 'ß')), l AS (SELECT upper(word) AS line FROM e UNION ALL SELECT word FROM e) SELECT line, count(*) AS n FROM l GROUP BY line")
def data_lines(spark, d):
    return sources.data_lines(spark, _list(spark, d)).groupBy("line").agg(F.count("*").alias("n"))


@query(f"WITH {_TOK}, w AS (SELECT word FROM voc WHERE lang = 'en' AND regexp_matches(word, '^[a-z]+$')) SELECT word AS lemma, CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN left(word, length(word) - 1) || 'ied' ELSE word || 'ed' END AS surface FROM w WHERE regexp_matches(word, '[^y]$|[^aeiou]y$') AND length(word) > 1 UNION SELECT word, word || 'ing' FROM w")
def dictionary_forms(spark, d):
    """Words with flags and the rules of two suffixes, as dictionary and affix files; every form that the rules give."""
    words = _vocabulary(spark, d).filter("lang = 'en' and word rlike '^[a-z]+$'").select(F.concat("word", F.lit("/AB")).alias("value"))
    rules = spark.createDataFrame([(x,) for x in ("SFX A Y 2", "SFX A y ied [^aeiou]y", "SFX A 0 ed [^y]", "SFX B Y 1", "SFX B 0 ing .")], "value string")
    lexicon = sources.hunspell_words(spark, _texts(spark, words, "dictionary"), "en")
    return sources.generated_forms(lexicon, sources.suffix_rules(spark, _texts(spark, rules, "affixes")))


@query(f"WITH {_TOK}, {_DAMAGED} SELECT damaged || ' ' || word AS original, word AS expected, way AS reason FROM d")
def written_cases(spark, d):
    rows = _damaged(spark, d).select(F.concat_ws("\t", F.concat("damaged", F.lit("\\s"), F.col("word")), F.col("word"), F.col("way")).alias("value"))
    rows = rows.filter(~F.col("value").startswith("#"))
    return sources.cases(spark, _texts(spark, rows, "cases"))


@query("SELECT epoch_us(ts) // 1000000 AS ts, event_type AS kind, 'w' || user_id AS word, props AS \"from\" FROM events WHERE event_type <> 'error'")
def journal_events(spark, d):
    """Events as JSON lines with broken ones between, kept where they are useful, and read back by their schema."""
    path = sources.shared_path(spark, "journal")
    e = read(spark, d, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("kind"), F.concat(F.lit("w"), "user_id").alias("word"), F.col("props").alias("from"))
    sources.append_journal(e, path, F.col("kind") != "error")
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(path)
    return sources.journal(spark, path, sources.EVENT).filter("kind is not null").select("ts", "kind", "word", "from")


@query("SELECT epoch_us(ts) // 1000000 AS ts, event_type AS \"from\", 'x' || event_type AS \"to\", user_id % 3 AS words FROM events WHERE event_type = 'click'")
def journal_corrections(spark, d):
    path = sources.shared_path(spark, "corrections")
    e = read(spark, d, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_type") == "click", "correction").otherwise("other").alias("kind"), F.col("event_type").alias("from"), F.concat(F.lit("x"), "event_type").alias("to"), (F.col("user_id") % 3).cast("int").alias("words"))
    sources.append_journal(e, path)
    return sources.journal(spark, path, sources.CORRECTION).filter("kind = 'correction'").select("ts", "from", "to", F.col("words").cast("long").alias("words"))


@query("SELECT user_id::VARCHAR AS group_id, event_type AS original, event_id::VARCHAR AS candidate, (event_type = 'purchase')::INT AS label FROM events WHERE user_id % 5 = 0")
def training_rows(spark, d):
    path = sources.shared_path(spark, "training")
    rows = read(spark, d, "events").filter("user_id % 5 = 0").select(F.col("user_id").cast("string").alias("group_id"), F.lit("").alias("context"), F.col("event_type").alias("original"), F.col("event_id").cast("string").alias("candidate"), F.lit("x\ty").alias("operation"), (F.col("event_type") == "purchase").cast("int").alias("label"), F.lit("s").alias("source"), F.lit("r").alias("reason"))
    sources.write_training_rows(rows, path)
    return sources.training_rows(spark, path).select("group_id", "original", "candidate", "label")


@query("SELECT count(*) AS n, count(*) FILTER (held) AS held_out FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) % 5 = 0 AS held, text FROM conversations WHERE text IS NOT NULL AND NOT contains(text, chr(10)) AND NOT contains(text, chr(13))) WHERE trim(text) <> ''")
def corpus_lines(spark, d):
    """Texts without line ends, one a line of a single file in order, and every fifth held out."""
    rows = read(spark, d, "conversations").filter(r"text is not null and not contains(text, '\n') and not contains(text, '\r')")
    path = _texts(spark, rows.coalesce(1).sortWithinPartitions("conv_id", "turn").select(F.to_json(F.struct("text")).alias("value")), "corpus")
    return sources.corpus_documents(spark, path, json=True).agg(F.count("*").alias("n"), F.count_if("held_out").alias("held_out"))


@query(f"WITH {_TOK}, {_DAMAGED} SELECT lang, word, way, damaged, CASE way WHEN 'none' THEN 0 WHEN 'swap' THEN CASE WHEN damaged = word THEN 0 ELSE 1 END WHEN 'move' THEN damerau_levenshtein(translate(damaged, '{_WIDE}', '{_BYTE}'), translate(word, '{_WIDE}', '{_BYTE}')) ELSE 1 END AS distance FROM d WHERE way <> 'move'")
def osa_distances(spark, d):
    rows = _damaged(spark, d).filter("way != 'move'")
    return rows.select("lang", "word", "way", "damaged", distance.osa_distance("damaged", "word").cast("long").alias("distance"))


@query(f"WITH {_TOK}, {_DAMAGED} SELECT lang, word, way, damaged, CASE way WHEN 'drop' THEN length(damaged) WHEN 'change' THEN length(word) - 1 ELSE length(word) END AS kept FROM d WHERE way IN ('drop', 'add', 'double', 'change', 'none')")
def common_subsequences(spark, d):
    rows = _damaged(spark, d).filter("way in ('drop', 'add', 'double', 'change', 'none')")
    return rows.select("lang", "word", "way", "damaged", distance.lcs_length("damaged", "word").cast("long").alias("kept"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS token FROM documents) SELECT token, CASE WHEN NOT regexp_matches(token, '\p{Ll}|\p{Lt}|\p{Lm}|\p{Lo}') THEN 'WORD' WHEN regexp_matches(token, '^\p{Lu}') THEN 'Word' ELSE 'word' END AS cased, CASE WHEN regexp_matches(token, '^\p{Lu}') THEN 'A phrase' ELSE 'a phrase' END AS phrase FROM w WHERE token <> ''""")
def word_cases(spark, d):
    from keyloom.functions import surface as S

    c = F.col("token")
    tokens = read(spark, d, "documents").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("token")).filter("token != ''").distinct()
    return tokens.select("token", X.word_case(c, F.lit("word")).alias("cased"), S.phrase_case(c, F.lit("a phrase")).alias("phrase"))


@query("SELECT vec_id, unnest(range(len(embedding))) AS cell, unnest(list_transform(embedding, lambda v: greatest(least(round(v::DOUBLE * 1000), 32767), -32768)::INT)) AS milli, unnest(list_transform(embedding, lambda v: greatest(least(round(v::DOUBLE * 127), 127), -127)::INT)) AS q FROM embeddings")
def quantized_cells(spark, d):
    cells = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("cell", "v")).withColumn("v", F.col("v").cast("double"))
    return cells.select("vec_id", F.col("cell").cast("long").alias("cell"), X.to_milli(F.col("v")).cast("int").alias("milli"), decide.quantized(F.col("v")).cast("int").alias("q"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN regexp_replace(text, '([\p{L}\p{N}]([^\t-\r ]*[\p{L}\p{N}])?)([^\p{L}\p{N}]*)\z', 'END\3') END AS replaced FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\x00-\x7F]')""")
def last_words_replaced(spark, d):
    rows = read(spark, d, "conversations").filter(r"text is not null and not text rlike '[^\\x00-\\x7F]'")
    return rows.select("conv_id", "turn", X.replace_last_word(F.col("text"), F.lit("END")).alias("replaced"))
