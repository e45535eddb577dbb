import pytest
from pyspark.sql import functions as F

from keyloom.functions import distance, text as X
from keyloom.plans import queries


def one(spark, value, f, *more):
    row = spark.createDataFrame([(value, *more)], ", ".join(f"c{i} string" for i in range(1 + len(more))))
    return row.select(f(*[F.col(f"c{i}") for i in range(1 + len(more))]).alias("x")).first().x


@pytest.mark.parametrize(("typed", "shown"), [("ghbdtn", "привет"), ("Vbh, 'nj!", "Мирб это!"), ("", ""), ("日本 7", "日本 7"), ("~`", "Ёё")])
def test_projection(spark, typed, shown):
    assert one(spark, typed, X.to_russian) == shown
    assert one(spark, shown, X.to_english) == typed


def test_projection_is_a_bijection():
    assert len(X.US) == len(X.RU) == len(set(X.US)) == len(set(X.RU)) == 73


@pytest.mark.parametrize(("text", "want"), [("привет ok", "ru2us"), ("hello мир", "us2ru"), ("", "us2ru"), ("аб ab", "us2ru")])
def test_direction(spark, text, want):
    assert one(spark, text, X.direction) == want


def test_pieces(spark):
    assert one(spark, "  a b\t", X.edge_whitespace).asDict() == {"lead": "  ", "core": "a b", "trail": "\t"}
    assert one(spark, "«ab-c!»", X.edge_punctuation).asDict() == {"lead": "«", "core": "ab-c", "trail": "!»"}
    assert [(s.text, s.is_ws) for s in one(spark, "a  b\n", X.segments)] == [("a", False), ("  ", True), ("b", False), ("\n", True)]
    assert one(spark, " Ab, c-d! ?", X.normalized_words) == ["ab", "c-d"]
    assert one(spark, "one two!  ", X.last_word) == "two"
    assert one(spark, "one (two)!  ", X.replace_last_word, "three") == "one (three)!  "
    assert one(spark, "x" * 25 + " ab-c d", X.words) == ["ab-c"]


@pytest.mark.parametrize(("original", "replacement", "want"), [("ПРИВЕТ", "мир", "МИР"), ("Привет", "мир", "Мир"), ("привет", "мир", "мир"), ("A1", "b", "B")])
def test_casing(spark, original, replacement, want):
    assert one(spark, original, X.word_case, replacement) == want


@pytest.mark.parametrize(
    ("core", "script", "kind"),
    [("", "empty", "empty"), ("слово", "cyrillic", "plain_word"), ("word", "ascii", "plain_word"), ("словоx", "mixed", "mixed_script"), ("42", "numeric", "technical"), ("日本", "other", "other"),
     ("--long=x", "other", "cli_option"), ("GitHub", "ascii", "technical"), ("USB", "ascii", "technical"), ("site.com", "ascii", "technical"), ("a@b", "ascii", "technical")],
)
def test_identity(spark, core, script, kind):
    assert one(spark, core, X.script) == script and one(spark, core, X.kind) == kind


def test_plausible(spark):
    assert one(spark, "of", X.plausible) and one(spark, "house", X.plausible)
    assert not one(spark, "ghbdtn", X.plausible) and not one(spark, "astrngth", X.plausible)
    assert one(spark, "...", X.plausibility) == 1.0 and one(spark, "house ghbdtn", X.plausibility) == 0.5


def test_expansions(spark):
    assert one(spark, "abb", X.one_deletions) == ["abb", "bb", "ab"]
    assert sorted(one(spark, "abb", X.adjacent_swaps)) == ["bab"]
    assert one(spark, "aabb", X.repeated_run_deletions) == ["abb", "aab"]
    assert sorted(one(spark, "a", lambda c: X.insertions(c, "xy"))) == ["ax", "ay", "xa", "ya"]
    assert one(spark, "ba", lambda c: X.substitutions(c, {"a": "eo"})) == ["be", "bo"]
    assert [(s.left, s.right) for s in one(spark, "abc", X.splits)] == [("a", "bc"), ("ab", "c")]
    assert one(spark, "", X.adjacent_swaps) == [] and one(spark, "a", X.splits) == []
    assert one(spark, "ab", X.trigrams) == ["^^a", "^ab", "ab$"]
    assert X.keyboard_neighbours()["ц"] == "йу"


def test_pairs(spark):
    assert one(spark, "abcd", X.common_prefix, "abxd") == 2 and one(spark, "", X.common_prefix, "a") == 0
    assert one(spark, "ab", X.is_adjacent_transposition, "ba") and not one(spark, "ab", X.is_adjacent_transposition, "ab")
    assert one(spark, "one two", X.changed_words, "one too") == 1 and one(spark, "one", X.changed_words, "a b c") == 3
    assert one(spark, "go tothe", X.boundary_split, "go to the") and not one(spark, "go tothe", X.boundary_split, "so to the")
    assert one(spark, "hello wrld", X.common_affix_edit, "hello world").asDict() == {"move_left": 3, "backspaces": 0, "insert": "o"}
    assert one(spark, "aa", X.common_affix_edit, "aaa").asDict() == {"move_left": 0, "backspaces": 0, "insert": "a"}


def test_numbers(spark):
    row = spark.range(1).select(X.to_milli(F.lit(0.0015)).alias("a"), X.to_milli(F.lit(-99.0)).alias("b"), X.depth_bucket(F.lit(5)).alias("c"), X.bucket(F.lit(7), [2, 8]).alias("d")).first()
    assert tuple(row) == (2, -32768, "4-7", "le8")


@pytest.mark.parametrize(("a", "b", "want"), [("ca", "abc", 3), ("йо", "ой", 1), ("", "abc", 3), ("abc", "abc", 0), ("рабоатет", "работает", 1)])
def test_distance(spark, a, b, want):
    assert distance.osa(a, b) == distance.osa(b, a) == want
    assert one(spark, a, distance.osa_distance, b) == want


def test_subsequence(spark):
    assert one(spark, "abcde", distance.lcs_length, "xaxcxe") == 3 and distance.lcs("", "a") == 0


def test_edit_plan_of_whole_texts(spark, tmp_path):
    long = "ab" * 4000
    texts = [long, long[:5000] + "X" + long[5000:], long + "end", "", "aa", "aaa", "é😀b", "é😁b", None, "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["edit_plan"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts) - 1))
    for i, (a, b) in enumerate(zip(texts, texts[1:])):
        if a is None or b is None:
            assert got[i] == (None, None, None)
            continue
        lead = max(k for k in range(min(len(a), len(b)) + 1) if a[:k] == b[:k])
        tail = max(k for k in range(min(len(a), len(b)) - lead + 1) if a[len(a) - k :] == b[len(b) - k :])
        assert got[i] == (tail, len(a) - lead - tail, b[lead : len(b) - tail])
    assert got[0] == (3000, 0, "X")
