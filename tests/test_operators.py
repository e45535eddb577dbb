import datetime as dt
import time

from pyspark.sql import functions as F

from keyloom.functions import distance
from keyloom.operators import candidates, corpus, decide, journal, ngram, rank
from keyloom.plans import queries
from keyloom.sources import text as S
from keyloom.streaming import batch, taps

import itertools
from collections import Counter


def lexicon(spark, words):
    return spark.createDataFrame([("x", w, n + 1) for n, w in enumerate(words)], "lang string, word string, cnt long")


def test_trigram_margins_prefer_real_words(spark):
    words = lexicon(spark, ["работает", "ладно", "явно", "плохо", "правильно", "рабочий", "складно", "славно", "направил"])
    model = ngram.train(words)
    pairs = spark.createDataFrame([("x", a, b) for a, b in [("рабоатет", "работает"), ("ландо", "ладно"), ("плозо", "плохо")]], "lang string, word string, candidate string")
    assert all(r.margin > 0 for r in ngram.margins(pairs, model).collect())


def test_neighbours_equal_brute_force(spark):
    words = ["мир", "мира", "рим", "мри", "пир", "мирра", "ми", "тир", "ярим"]
    got = {(r.word, r.candidate) for r in candidates.neighbours(lexicon(spark, words), lexicon(spark, words)).collect()}
    assert got == {(a, b) for a, b in itertools.permutations(words, 2) if distance.osa(a, b) <= 1}


def test_candidates(spark):
    known = lexicon(spark, ["привет", "мир", "приветмир", "миру"])
    typed = lexicon(spark, ["првиет", "прривет", "приве", "приветмиру"])
    assert [(r.word, r.candidate) for r in candidates.transpositions(typed, known).collect()] == [("првиет", "привет")]
    assert [(r.word, r.candidate) for r in candidates.repeated_letters(typed, known).collect()] == [("прривет", "привет")]
    assert {(r.word, r.candidate) for r in candidates.missing_letters(typed, known).collect()} == {("приве", "привет")}
    assert {(r.word, r.left, r.right) for r in candidates.glued(typed, known).collect()} == {("приветмиру", "привет", "миру")}


def test_ranking(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5000000001), (1, "c", 0.2), (2, "z", 1.0)], "k int, t string, s double")
    got = {r.k: r for r in rank.best_two(df, ["k"], "s", "t").collect()}
    assert (got[1].best, got[1].second, got[1].margin) == ("a", "b", 0.0) and got[2].second is None
    assert [r.k for r in rank.best_with_gap(df, ["k"], "s", "t", 0.1).collect()] == [2]
    nums = spark.createDataFrame([(1, i) for i in range(1, 11)], "k int, v int")
    assert rank.floor_rank(nums, ["k"], "v", {"p99": 99}).first().p99 == 9
    assert rank.nearest_rank(nums, ["k"], "v", {"p99": 0.99}).first().p99 == 10


def test_journal(spark):
    ctx = spark.createDataFrame([(["a", "b", "c"],), ([],)], "c array<string>")
    assert [r.k for r in ctx.select(journal.backoff_keys(F.col("c")).alias("k")).collect()] == [["c", "b c", "a b c"], []]
    rows = spark.createDataFrame([("s", "t1", 5), ("s", "t1", 9), ("s", "t2", 1), ("s", "t2", 2), ("s", "t3", 0), ("q", "t", 1)], "f string, t string, ts int")
    got = {(r.f, r.t): r.promoted for r in journal.promoted(rows, "f", "t", "ts").collect()}
    assert got == {("s", "t1"): False, ("s", "t2"): True, ("s", "t3"): False, ("q", "t"): False}
    lines = spark.createDataFrame([(1, i, w) for i, w in enumerate(["one", "two", "three", "four"])], "k int, i int, line string")
    assert sorted(r.line for r in journal.byte_tail(lines, ["k"], "i", "line", 10).collect()) == ["four", "three"]


def test_corpus(spark):
    words = lexicon(spark, ["ab", "ac", "ad", "bb"])
    assert {r.word: r.distractor for r in corpus.cyclic_distractors(words).collect()} == {"ab": "ac", "ac": "ad", "ad": "ab", "bb": None}
    assert [r.x for r in spark.createDataFrame([(1,), (2,), (255,), (10**6,)], "c long").select(corpus.repetitions(F.col("c")).alias("x")).collect()] == [1, 2, 8, 8]


def stamps(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def test_double_taps(spark):
    sessions = {"one": [0], "two": [0, 20], "four": [0, 20, 40, 60], "ten": [20 * i for i in range(10)], "late": [0, 251], "chain": [0, 251, 400]}
    rows = [(s, i, stamps(t), True) for s, ts in sessions.items() for i, t in enumerate(ts)]
    rows += [("cut", 0, stamps(0), True), ("cut", 1, stamps(10), False), ("cut", 2, stamps(20), True), ("cut", 3, stamps(30), True)]
    df = spark.createDataFrame(rows, "session string, ord long, ts timestamp, is_tap boolean")
    got = batch.double_taps(df, "session", ["ts", "ord"], "ts", F.col("is_tap"), 0.25).groupBy("session").count().collect()
    want = {"two": 1, "four": 2, "ten": 5, "chain": 1, "cut": 1}
    assert {r.session: r["count"] for r in got} == want


def test_double_taps_as_a_stream(spark, tmp_path):
    rows = [("two", 0, stamps(0), True), ("four", 0, stamps(0), True), ("four", 1, stamps(20), True), ("late", 0, stamps(0), True)]
    more = [("two", 1, stamps(200), True), ("four", 2, stamps(40), True), ("four", 3, stamps(60), True), ("late", 1, stamps(300), True), ("late", 2, stamps(301), False), ("late", 3, stamps(302), True)]
    schema = "session string, ord long, ts timestamp, is_tap boolean"
    for part in (rows, more):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = taps.double_taps(events).writeStream.format("memory").queryName("taps").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.session, r.ord) for r in spark.table("taps").collect()} == {("two", 1), ("four", 1), ("four", 3)}


def test_sources(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\n\nМир\n мир \nhello\nслово-дело\n", encoding="utf-8")
    assert sorted(r.word for r in S.plain_words(spark, str(tmp_path / "w.txt"), "ru").collect()) == ["мир", "слово-дело"]
    (tmp_path / "d.dic").write_text("3\ntry/AB\nwalk/B\nsky\n")
    (tmp_path / "d.aff").write_text("SFX A Y 1\nSFX A y ied [^aeiou]y\nSFX B Y 1\nSFX B 0 ing .\n")
    words = S.hunspell_words(spark, str(tmp_path / "d.dic"), "en")
    forms = {(r.lemma, r.surface) for r in S.generated_forms(words, S.suffix_rules(spark, str(tmp_path / "d.aff"))).collect()}
    assert forms == {("try", "tried"), ("try", "trying"), ("walk", "walking")}
    (tmp_path / "c.tsv").write_text("a\\sb\tab\twhy\nx\n")
    assert [tuple(r) for r in S.cases(spark, str(tmp_path / "c.tsv")).collect()] == [("a b", "ab", "why")]
    (tmp_path / "e.jsonl").write_text('{"ts": 1, "kind": "word", "word": "a"}\nbroken\n')
    assert S.journal(spark, str(tmp_path / "e.jsonl"), S.EVENT).count() == 1
    a, b = lexicon(spark, ["a", "b", "a"]), lexicon(spark, ["b", "a"])
    assert S.fingerprint(a).first() == S.fingerprint(b).first() != S.fingerprint(lexicon(spark, ["a"])).first()
    got = S.fragments(spark.createDataFrame([(1, "one. two three four! " + "x" * 30 + " y z")], "doc_id long, text string"), 3, 20).collect()
    assert [r.reject for r in got] == ["tokens", None, "oversized"]


def test_queries_over_the_whole_vocabulary(spark, tmp_path):
    """Rare words on both sides, against brute force."""
    texts = ["planet " * 6 + "garden " * 5 + "plant", "planets palnet gardem garden", "gaardn planet lanterns"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    count = Counter(" ".join(texts).split())
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    pairs = {(a, b) for a in count for b in count if a != b and distance.osa(a, b) == 1}
    assert {(r.word, r.candidate) for r in run("deletion_key_neighbors")} == pairs and ("plant", "planet") in pairs
    assert sorted(r.word for r in run("ngram_margin_swap")) == sorted(w for w in count if w[0] != w[1] and len(w) >= 4)
    grams = lambda w: {f"^^{w}$"[k : k + 3] for k in range(len(w) + 1)}
    want = {(a, b, len(grams(a) & grams(b))) for a in count for b in count if count[a] < 5 <= count[b] and len(grams(a) & grams(b)) >= 3}
    assert {(r.word, r.candidate, r.overlap) for r in run("surface_overlap_candidates")} == want and len(want) >= 4


def test_presence_features(spark):
    words = ["a", "ab", "abcab", "planet", "lantern", "сло-во"]
    want = Counter()
    for w in words:
        edges = {x for n in range(1, min(len(w), 5) + 1) for x in ("^" + w[:n], w[-n:] + "$")}
        want.update({w[i : i + n] for n in range(2, 5) for i in range(len(w) - n + 1)} | edges | ({f"^{w}$"} if len(w) <= 5 else set()))
    assert {r.feature: r.n for r in corpus.presence_features(lexicon(spark, words)).collect()} == want


def test_candidates_of_a_long_text(spark):
    """Time by the text's length, not its square; equal candidates once, within a row and between rows of a key."""
    words = [f"word{k}" for k in range(20_000)]
    rows = [(1, " ".join(words)), (2, " \n"), (3, None), (4, ""), (5, " one two "), (6, "ab"), (6, "фи"), (6, "ab")]
    began = time.monotonic()
    got = decide.candidate_map(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert time.monotonic() - began < 60
    by = {(r.id, r.name): r.candidate for r in got}
    assert by[1, "flip_first"] == " ".join(["цщкв0", *words[1:]]) and by[1, "flip_last"] == " ".join([*words[:-1], "цщкв19999"])
    assert by[5, "flip_first"] == " щту two " and by[5, "flip_last"] == " one ецщ "
    assert sorted((r.ord, r.name, r.candidate) for r in got if r.id in (2, 4)) == [(0, "keep", ""), (0, "keep", " \n")]
    assert [(r.ord, r.candidate) for r in got if r.id == 3] == [(0, None)]
    assert sorted((r.ord, r.candidate) for r in got if r.id == 6) == [(0, "ab"), (0, "фи")]


def test_overlaps_need_no_pairs(spark, monkeypatch):
    """No join makes pairs of words, which grow with the square of the vocabulary; several shards give the same."""
    words = spark.createDataFrame([("en", "planet"), ("fr", "planet"), ("en", "")], "lang string, word string")
    known = spark.createDataFrame([("en", w) for w in ("planets", "plant", "planet", "lane", "aplanet", "planer", "plan")], "lang string, word string")
    want = [("planet", "planets", 6, 1), ("planet", "aplanet", 5, 2), ("planet", "planer", 5, 3)]
    for shard in (decide.SHARD, 2):
        monkeypatch.setattr(decide, "SHARD", shard)
        found = decide.overlap_candidates(words, known, 3, 3)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert [(r.word, r.candidate, r.overlap, r.place) for r in found.orderBy("place").collect()] == want
