"""Surfaces, scores, edits, memory and key streams against golden values and plain versions."""

import itertools

import pytest
from pyspark.sql import functions as F

from keyloom.functions import surface as S
from keyloom.functions import text as X
from keyloom.operators import contexts, corpus, decide, journal, keys, memory, rank, safety, score
from keyloom.streaming import batch


def values(spark, rows, names, **columns):
    return spark.createDataFrame(rows, names).select(*[c.alias(k) for k, c in columns.items()]).collect()


def omissions(a, b):
    """Greedy reading of b along a, as the rule has it."""
    k = len(b) - len(a)
    if k not in (2, 3) or a[-1:] != b[-1:]:
        return None
    at, gone = 0, []
    for i, ch in enumerate(b):
        if at < len(a) and a[at] == ch:
            at += 1
        else:
            gone.append(i)
    if at != len(a) or len(gone) != k or len(b) - 1 in gone or all(y == x + 1 for x, y in zip(gone, gone[1:])):
        return None
    return k if a[0] == b[0] or gone.count(0) == 1 else None


def test_geometry_equals_plain_versions(spark):
    words = ["привет", "пирвет", "првет", "рпивет", "прет", "пвт", "пиврет", "приветт", "абвгде", "агбвде", "абве", "ааббвв"]
    pairs = [(a, b) for a, b in itertools.product(words, words)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.sparse_omissions(F.col("a"), F.col("b")).alias("o"), S.is_internal_move(F.col("a"), F.col("b")).alias("m"), S.removes_one(F.col("a"), F.col("b")).alias("r"), X.common_prefix(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        a, b = r.a, r.b
        moves = {w[:j] + a[i] + w[j:] for i in range(1, len(a) - 1) for w in [a[:i] + a[i + 1 :]] for j in range(1, len(w))}
        assert r.o == omissions(a, b), (a, b)
        assert r.m == (len(a) == len(b) >= 5 and a != b and a[0] == b[0] and a[-1] == b[-1] and b in moves), (a, b)
        assert r.r == (b in {a[:i] + a[i + 1 :] for i in range(len(a))})
        assert r.p == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_classes_of_errors(spark):
    cases = [("првиет", "привет", "adjacent-transposition"), ("прривет", "привет", "repeated-letter"), ("приввет", "привет", "repeated-letter"), ("привтет", "привет", "extra-letter"), ("приет", "привет", "missing-letter"), ("прибет", "привет", "letter-substitution"), ("шривеш", "привет", "composite-typo"), ("привет", "привет", "unknown")]
    got = spark.createDataFrame(cases, "a string, b string, want string").select("want", S.typo_class(F.col("a"), F.col("b"), F.lit("unknown")).alias("c")).collect()
    assert [r.c for r in got] == [r.want for r in got]
    layout = values(spark, [("a", "b")], "a string, b string", c=S.typo_class(F.col("a"), F.col("b"), F.lit("wrong-layout")), d=S.typo_class(F.lit("шривеш"), F.lit("привет"), F.lit("wrong-layout")))
    assert layout[0].d == "wrong-layout"


def test_surfaces(spark):
    r = values(spark, [("«Привет,» мир!  ",)], "t string", ws=S.trailing_whitespace(F.col("t")), last=S.last_alphabetic_token(F.col("t")), tail=S.last_ws_token(F.col("t")), words=S.memory_words(F.col("t")), both=S.context_and_last(F.col("t")), previous=S.previous_token(F.col("t"), F.lit(2)), flip=S.flip_token(F.lit("ghbdtn мир"), F.lit(0)), end=S.flip_token(F.lit("ghbdtn vbh"), F.lit(-1)))[0]
    assert (r.ws, r.last, r.tail, r.words, r.previous, r.flip, r.end) == (2, "мир", None, ["привет", "мир"], "«Привет,»", "привет мир", "ghbdtn мир")
    assert (r.both.context, r.both.word) == (["привет"], "мир")
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame([("a b c", "a x c"), ("a b", "a b"), ("", "z"), ("a b", "a b c d")], "a string, b string").select(S.changed_targets(S.memory_words(a), S.memory_words(b)).alias("i"), S.transition_context(a, b).alias("c"), S.left_context_changed(a, b).alias("l")).collect()
    assert [r.i for r in got] == [[1], [1], [0], [2, 3]] and [r.c for r in got] == [["a"], ["a"], [], ["a", "b"]]
    low = values(spark, [("12 a",), ("ab 1",), ("",)], "t string", x=S.alpha_is_low(F.col("t")))
    assert [r.x for r in low] == [True, False, True]


def test_scores(spark):
    r = values(spark, [(0, 3, 10**9)], "a long, b long, c long", zero=score.accepted_prior(F.col("a")), some=score.repulsion(F.col("b")), top=score.attraction(F.col("c")), none=score.transition_signal(F.col("a"), F.col("a")), repels=score.transition_signal(F.col("a"), F.col("b")), boost=score.corpus_rank_boost(F.lit(4999)), done=score.completion_score(F.lit(0), F.lit(500), F.lit(7), F.lit(40)))[0]
    assert r.zero == 0 and abs(r.some - 0.083178) < 1e-6 and r.top == 0.32 and r.none.reason == "transition_empty" and r.repels.reason == "transition_repels" and r.repels.weight < 0
    assert (r.boost, r.done) == (500, 640 + 7 + 128 + 360 - 160)
    pair = [("яслово", "я слово"), ("я слово", "я  слово!"), ("a", "b")]
    assert [x.s for x in values(spark, pair, "a string, b string", s=score.structure_bonus(F.col("a"), F.col("b")))] == [4.0, 0.0, 0.0]
    likely = values(spark, [("missing-letter", 1, 6), ("composite-typo", 2, 6), ("unknown", 1, 6), ("wrong-layout", 6, 6)], "e string, d int, n int", p=score.likelihood(F.col("e"), F.lit(False), F.col("d"), F.col("n")))
    assert [round(x.p, 4) for x in likely] == [0.8333, 0.6667, 0.45, 0.96]
    rows = spark.createDataFrame([(1, "a", 1, 5), (1, "b", 1, 9), (1, "c", 2, 99), (2, "a", 1, 5), (3, "a", 1, 5), (3, "b", 1, 5)], "k int, t string, d int, e int")
    assert [(r.k, r.winner, r.margin) for r in score.tied_winner(rows, ["k"], "d", "e", "t").collect()] == [(1, "b", 4)]
    order = spark.createDataFrame([(1, 0.5, 0.1, True, 1, "b"), (1, 0.5, 0.1, True, 1, "a"), (1, 0.9, 0.9, False, 2, "c")], "k int, rank_score double, risk double, verified boolean, changed int, replacement string")
    assert [r.replacement for r in score.in_decision_order(order, "k").orderBy("place").collect()] == ["c", "a", "b"]
    same = values(spark, [([1, 0], [1, 0]), ([1, 0], [-1, 0]), ([0, 0], [1, 0])], "a array<int>, b array<int>", c=score.coherence_milli(F.col("a"), F.col("b")))
    assert [r.c for r in same] == [1000, 0, 0]


def test_decisions(spark):
    sides = [("known", "known", 0, 0, "english"), ("scored", "known", 9, 0, "russian"), ("special", "known", 0, 0, "special"), ("unavailable", "known", 0, 0, "unavailable"), ("scored", "scored", 0, 0, "ambiguous"), ("scored", "scored", 3, 3, "russian"), ("scored", "scored", 4, 3, "english")]
    got = spark.createDataFrame(sides, "e string, r string, x int, y int, want string").select("want", decide.layout_decision(F.col("e"), F.col("r"), F.col("x"), F.col("y")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert [r.b for r in values(spark, [(0,), (999,), (1000,), (10_000,), (50_000,)], "r int", b=decide.rank_bonus(F.col("r")))] == [6.0, 6.0, 3.0, 1.0, 0.0]
    record = {"kind": F.lit("learned"), "from": F.lit("a b"), "to": F.lit("x b c")}
    fields = lambda **more: (lambda name: {**record, **more}.get(name, F.lit(None)))
    r = values(spark, [(1,)], "k int", a=decide.unsafe_reasons(fields()), b=decide.unsafe_reasons(fields(to=F.lit("x b"), selected_source=F.lit("nanda"))), c=decide.unsafe_reasons(fields(kind=F.lit("candidate_before_apply"), action_kind=F.lit("block_unsafe"), safety_allow_apply=F.lit(False))))[0]
    assert r.a == ["word_count_changed"] and r.b == ["left_context_changed", "nanda_multiword"] and r.c == []
    circle = spark.createDataFrame([(1, [3.1, 0.0]), (1, [-3.1, 0.2])], "k int, v array<double>")
    mean = {r.cell: r["mean"] for r in decide.centers(circle, "k", "v").collect()}
    assert abs(abs(mean[0]) - 3.14159) < 1e-3 and abs(mean[1] - 0.1) < 1e-9


@pytest.mark.parametrize("a, b, left, back, insert, proof, reason, touched", [
    ("привет мр", "привет мир", 1, 0, "и", "context", "unsafe_multiword_autocorrect_scope", 1), ("слово", "слово!", 0, 0, "!", None, "safe_edit_plan", 0), ("слвово", "слово", 3, 1, "", None, "unsafe_middle_suffix_autocorrect_plan", 1),
    ("слвово", "слово", 0, 6, "слово", None, "safe_edit_plan", 1), ("ab", "abc", 9, 0, "c", None, "invalid_edit_plan_cursor_bounds", 0), ("ab", "abc", 0, 0, "d", None, "edit_plan_dry_run_mismatch", 0), ("приветмир", "привет мир", 3, 0, " ", "boundary", "safe_edit_plan", 1),
])
def test_edit_safety(spark, a, b, left, back, insert, proof, reason, touched):
    df = spark.createDataFrame([(a, b, left, back, insert, proof)], "a string, b string, l int, k int, i string, p string")
    r = df.select(safety.report(F.col("a"), F.col("b"), F.col("l"), F.col("k"), F.col("i"), F.col("p")).alias("r"), safety.matches(F.col("a"), F.col("b"), F.col("l"), F.col("k"), F.col("i")).alias("m")).first()
    assert (r.r.reason, r.r.touched, r.r.allowed) == (reason, touched, reason == "safe_edit_plan")
    assert r.m == (reason not in ("invalid_edit_plan_cursor_bounds", "edit_plan_dry_run_mismatch"))


def test_memory(spark):
    votes = spark.createDataFrame([("a", e) for e in (5, 1, 1, 9, 3)] + [("b", 2)], "word string, episode long")
    assert {r.word: (r.votes, r.episodes) for r in memory.episode_votes(votes, ["word"], "episode").collect()} == {"a": (3, [1, 3, 5]), "b": (1, [2])}
    base = spark.createDataFrame([("a", 2, 7), ("b", 1, 9)], "word string, support long, threshold int")
    delta = spark.createDataFrame([("a", 3), ("c", 1)], "word string, support long")
    assert {tuple(r) for r in memory.composed(base, [delta, delta], ["word"], 5).collect()} == {("a", 8, 7), ("b", 1, 9), ("c", 2, 5)}
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1)], "word string, generation int")
    assert {tuple(r) for r in memory.without_tombstones(rows, rows.filter("generation = 1 and word = 'a'"), ["word"]).collect()} == {("a", 3), ("b", 1)}
    counts = spark.createDataFrame([(f"w{i}", i % 50 + 1) for i in range(3000)], "word string, cnt long")
    made = memory.estimates(counts, F.col("word"), memory.sketch(counts, F.col("word"), F.col("cnt"))).collect()
    assert all(r.estimate >= r.cnt for r in made) and sum(r.estimate == r.cnt for r in made) > 2900


def test_keys(spark):
    df = spark.createDataFrame([(1, " ghbdtn  vbh "), (2, ""), (3, None)], "id long, text string")
    got = keys.event_words(keys.key_events(df, ["id"], "text"), ["id"]).collect()
    assert {(r.word_no, r.typed, r.opposite) for r in got} == {(1, "ghbdtn", "привет"), (2, "vbh", "мир")}
    assert [r.j for r in values(spark, [("abc", "bcd"), ("abc", "xyz"), ("", "a"), ("aa", "aa")], "a string, b string", j=keys.joined(F.col("a"), F.col("b")))] == ["abcd", "abcxyz", "a", "aa"]
    known = spark.createDataFrame([("ru", "привет"), ("en", "hello")], "lang string, word string")
    typed = spark.createDataFrame([("(ghbdtn!",), ("hello",), ("руддщ",), ("zzz",)], "token string")
    assert {(r.token, r.replacement) for r in keys.layout_corrections(typed, known).collect()} == {("(ghbdtn!", "(привет!"), ("руддщ", "hello")}
    lexicon = spark.createDataFrame([("x", w) for w in ("мир", "привет", "труд")], "lang string, word string")
    words = spark.createDataFrame([("x", "мирприветтруд"), ("x", "мирпривет")], "lang string, word string")
    assert {(r.word, r.parts, r.n) for r in keys.segmentations(words, lexicon).collect()} == {("мирприветтруд", "мир привет труд", 3), ("мирпривет", "мир привет", 2)}


def test_contexts_stay_in_their_row(spark):
    docs = spark.createDataFrame([(1, "en", "aa bb cc"), (2, "en", "dd"), (3, "en", None)], "doc_id long, lang string, text string")
    assert {tuple(r) for r in contexts.pairs(docs).collect()} == {("en", "aa", "bb"), ("en", "bb", "cc")}
    assert {tuple(r) for r in contexts.backoff(docs).collect()} == {("aa", "bb"), ("bb", "cc"), ("aa bb", "cc")}
    assert {(r.word, r.context) for r in contexts.frames(docs).collect()} == {("aa", "_ bb cc"), ("bb", "aa _ cc"), ("cc", "aa bb _"), ("dd", "_")}


def test_ranks_of_hot_and_equal_values(spark):
    rows = spark.createDataFrame([("a", 5.0)] * 90 + [("a", float(i)) for i in range(10)] + [("b", 1.0)], "k string, v double")
    got = {r.k: r for r in rank.floor_rank(rows, ["k"], "v", {"p5": 5, "p50": 50, "p99": 99}).collect()}
    plain = sorted([5.0] * 90 + [float(i) for i in range(10)])
    assert (got["a"].p5, got["a"].p50, got["a"].p99, got["a"].n) == (plain[4], plain[49], plain[98], 100) and got["b"].p50 == 1.0
    placed = rank.ordinal(rows.distinct(), ["k"], F.floor(F.col("v") / 4), ["v"], "i").filter("k = 'a'").orderBy("i").collect()
    assert [r.v for r in placed] == [float(i) for i in range(10)] and [r.i for r in placed] == list(range(1, 11))
    ema = journal.ema(spark.createDataFrame([(1, i, float(i * i)) for i in range(6)], "k int, i int, v double"), ["k"], ["i"], "v", 0.2).first().ema
    want = 0.0
    for i in range(1, 6):
        want = want * 0.8 + i * i * 0.2
    assert abs(ema - want) < 1e-12


def test_outcomes(spark):
    rows = spark.createDataFrame([(1, 0, "p"), (1, 5, "p"), (1, 7, "o"), (1, 9, "p"), (2, 1, "o"), (2, 2, "p"), (2, 50, "o")], "k int, s int, kind string").withColumn("ts", F.timestamp_seconds("s"))
    got = batch.outcomes(rows, "k", ["ts"], "ts", F.col("kind") == "p", F.col("kind") == "o", ["s"], 10.0).collect()
    assert {(r.k, r.s): r.hit and r.hit.s for r in got} == {(1, 0): 7, (1, 5): 7, (1, 9): None, (2, 2): None}


def test_damage(spark):
    words = spark.createDataFrame([("привет", 0), ("привет", 1), ("капелька", 5)], "w string, s int")
    got = words.select("w", "s", *[c.alias(k) for k, c in corpus.damaged_letters(F.col("w"), F.col("s")).items()]).collect()
    for r in got:
        w, s = list(r.w), r.s
        at = 1 + s % (len(w) - 2)
        other = "о" if w[at] == "а" else "а"
        first = 1 + s % (len(w) - 3)
        sw = w[:first] + [w[first + 1], w[first]] + w[first + 2 :]
        second = min(first + 2, len(w) - 2)
        sw[second] = "и" if sw[second] == "е" else "е"
        assert (r.extra, r.substitution, r.completion, r.composite) == ("".join(w[:at] + [other] + w[at:]), "".join(w[:at] + [other] + w[at + 1 :]), r.w[: len(w) - 2 - s % 2], "".join(sw))


def test_rules_on_texts(spark):
    a, b = F.col("a"), F.col("b")
    pairs = [("првиет", "привет", True), ("длинное", "ок", False), ("а б", "аб", True), ("x", "x", False), ("", "y", False), ("слово", "а б в г", False)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", S.safe_replacement(a, b, F.lit(False)).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    cases = values(spark, [("ПриВет",), ("приВЕТ",), ("ПРИВЕТ",), ("Привет",), ("Hello",)], "a string", c=S.mixed_case(a))
    assert [r.c for r in cases] == ["Привет", "привет", None, None, None]
    shifts = values(spark, [("пр ивет", "при вет"), ("пр ивет", "приве т"), ("аб вг", "аб вг"), ("приве т", "прив ет")], "a string, b string", s=S.boundary_shifted(a, b))
    assert [r.s for r in shifts] == [True, False, False, True]
    last = values(spark, [(" Один «два», три ",), ("один",), ("b c",)], "a string", r=S.replace_word_before_last(a, F.lit("b")))
    assert [r.r for r in last] == [" Один «b», три ", None, None]
    reasons = values(spark, [("нормальный текст",), ("a=b",), ("",), ("12 34 5 a",), ("ls -la dir",), ("см. http://x",)], "a string", r=S.reject_reason(a))
    assert [r.r for r in reasons] == [None, "unsafe_text", "unsafe_text", "low_language_quality", "unsafe_text", "unsafe_text"]
    layouts = values(spark, [("привет hi",), ("hi",), ("12",)], "a string", r=S.preferred_russian(a, F.lit(True)))
    assert [r.r for r in layouts] == [True, False, True]
    lost = values(spark, [("a b", "ab", "typo"), ("a b", "ab", "glued_phrase"), ("a", "", "typo")], "a string, b string, r string", x=S.loses_words(a, b, F.col("r")))
    assert [r.x for r in lost] == [True, False, False]


def test_only_wanted_contexts_are_shuffled(spark, monkeypatch):
    """Counts of the wanted keys are whole, in one slice or several; other keys go before the shuffle."""
    docs = spark.createDataFrame([(1, "en", "aa bb cc"), (2, "en", "xx aa bb cc"), (3, "en", " ".join(f"other{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)))], "doc_id long, lang string, text string")
    wanted = spark.createDataFrame([("aa bb", "cc"), ("xx", "aa"), ("xx", "nowhere"), ("aa", "bb"), ("aa", "bb")], "key string, word string")
    for keys in (contexts.SIEVE_KEYS, 2):
        monkeypatch.setattr(contexts, "SIEVE_KEYS", keys)
        found = contexts.counts_of(docs, wanted)
        assert {tuple(r) for r in found.collect()} == {("aa bb", "cc", 2), ("xx", "aa", 1), ("aa", "bb", 2)}
        assert contexts._held(contexts.backoff(docs), wanted, 1).count() < 20 < contexts.backoff(docs).count()


def test_rare_contexts_are_not_counted(spark, monkeypatch):
    """Longer contexts are counted only where their parts are frequent; the counts are those of all contexts."""
    texts = ["aa bb cc dd ee ff gg", "bb cc dd ee ff", "xx cc dd ee ff hh", "aa bb cc", "", None] + [f"one{chr(97 + i)} two{chr(97 + i)} three{chr(97 + i)} cc dd ee" for i in range(20)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    plain = contexts.backoff(docs).groupBy("key", "word").count().filter("count >= 3")
    asked, held = [], contexts._held

    def seen(rows, wanted, seed):
        found = held(rows, wanted, seed)
        asked.append((rows.count(), found.count()))
        return found

    monkeypatch.setattr(contexts, "_held", seen)
    got = contexts.frequent(docs, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.filter("key = 'cc dd'").count() == 1
    assert asked[0] == (93, 51) and asked[-1][1] == 0
