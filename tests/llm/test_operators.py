import hashlib
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom.llm import ann, chat_format, decontaminate, language_id, line_dedup, minhash_dedup, packing, token_planes, tokens, toxicity, warc
from keyloom.llm.common import in_group, new_path
from tests.llm.texts import components, corpus, edited, prose, shingles

DOCS = "doc_id long, text string, entry string, label int, component long"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def odd(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return frame(spark, [(*r, "e", 1, 2) for r in rows], DOCS)


# Near duplicates


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = minhash_dedup.near_duplicates(odd(spark, rows).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert len(got) == len(rows)


def test_near_duplicates_odd_rows(spark):
    got = minhash_dedup.near_duplicates(frame(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c"), (1, None), (5, "a b c")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, False), (1, 1, True), (2, 2, True), (2, 2, True), (5, 2, False)]
    assert minhash_dedup.near_duplicates(frame(spark, [])).collect() == []


# Chats


def test_chats_round_trip(spark):
    parts = ["<|im_start|>", "<|im_end|>", "\n", "a", "\\", "<", "|", "<\\|", "", "é", "%0A", "%"]
    rng = random.Random(2)
    rows = [(c, t, "".join(rng.choices(["user", "assistant", "<|", "\n", "%", "\\"], k=1)), "".join(rng.choices(parts, k=rng.randrange(6)))) for c in range(150) for t in range(rng.randrange(1, 5))]
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (900, 0, None, None), (901, None, "assistant", "x"), (None, 1, "user", "y"), (902, 0, "assistant", "b"), (902, 0, "assistant", "b")]
    got = chat_format.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.round_trip for r in got) and len(got) == len({r[0] for r in rows})
    for r in got:
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in own]
        assert r.loss_text == "".join(x[2] for x in own if x[1] == "assistant")
        assert r.escaped or not any("<|" in x[2] for x in own)
        assert len(r.formatted.split("<|im_start|>")) == len(own) + 1


# Lines


def osa_free(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def wordy(*args):
    return prose(*args).replace("w", "word")


def test_lines(spark):
    rng = random.Random(5)
    hot, line = wordy(rng, 12), wordy(rng, 300)
    rows = []
    for i in range(40):
        own = [wordy(rng, rng.randrange(5, 15)) for _ in range(3)]
        rows.append((i, "\n".join([own[0], hot.upper() + "!" if i % 3 == 0 else own[1], "", "short line", own[2], edited(rng, line, 1) if i % 4 == 0 else "  "])))
    rows += [(50, None), (51, ""), (52, hot), (52, hot), (None, hot), (53, "\n\n"), (54, " ".join(["w%d" % (k % 977) for k in range(40_000)])), (55, " ".join(["w%d" % (k % 977) for k in range(40_000)]) + " .")]
    got = line_dedup.dedup_lines(odd(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "entry", "label", "component", "n_lines", "n_removed"}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[50][0].text is None and by[51][0].text == "" and by[53][0].text == "\n\n"
    assert by[52][0].text == by[52][1].text == "" and by[None][0].text == hot
    assert by[54][0].text and by[55][0].text == ""
    assert by[0][0].n_removed == 0 and hot.upper() + "!" in by[0][0].text
    for i, text in rows[1:40]:
        lines, left = text.split("\n"), by[i][0].text.split("\n")
        assert left[0] == lines[0] and "short line" in left and "" in left and lines[4] in left
        assert (hot.upper() + "!" in left) == False  # noqa: E712
    similar = [t.split("\n")[5] for i, t in rows[:40] if i % 4 == 0]
    kept = [x for i, _ in rows[:40] if i % 4 == 0 for x in by[i][0].text.split("\n") if x in similar]
    # What meets in a block is linked; every line that goes is similar to one that stays or went before.
    assert 1 <= len(kept) < len(similar)
    assert all(osa_free(a, similar[0]) <= 0.2 * max(len(a), len(similar[0])) for a in similar[1:3])


def line_links(rows):
    """Lines by the stated rule alone, over every pair: (words of each, links)."""
    norm = {(i, k): line.split(" ") for i, t in rows for k, line in enumerate(t.split("\n"))}
    return norm, [(p, q) for p, q in itertools.combinations(sorted(norm), 2) if osa_free(norm[p], norm[q]) <= 0.2 * max(len(norm[p]), len(norm[q])) + 1e-7]


def kept_lines(rows, norm, links):
    low = components(sorted(norm), links)
    return {i: "\n".join(line for k, line in enumerate(t.split("\n")) if low[i, k] == (i, k)) for i, t in rows}


def test_lines_equal_brute_force(spark, monkeypatch):
    """Few edits: every link is found, with and without lists that are split; extra columns with names of the operator's."""
    rng = random.Random(8)
    base = [wordy(rng, rng.randrange(5, 60), 300) for _ in range(30)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.randrange(2)) for _ in range(4))) for i in range(60)]
    want = kept_lines(rows, *line_links(rows))
    clash = "doc_id long, n_lines string, text string, row int, `_ld_x` int, hit int, N_Removed int"
    for hot, exact in ((line_dedup.HOT, False), (line_dedup.HOT, True), (3, False)):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = line_dedup.dedup_lines(spark.createDataFrame([(i, "x", t, 1, 2, 3, 4) for i, t in rows], clash), exact=exact)
        assert got.columns == ["doc_id", "text", "row", "_ld_x", "hit", "n_lines", "n_removed"]
        assert {r.doc_id: r.text for r in got.collect()} == want
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


@pytest.mark.parametrize("words, edits", [(5, 1), (8, 1), (10, 1), (10, 2), (20, 1), (20, 4), (40, 1), (40, 8), (100, 20), (200, 40)])
def test_similar_lines_meet(spark, words, edits):
    """Recall over all pairs that are similar by edits alone: lines and their copies with words replaced."""
    rng = random.Random(words)
    base = [wordy(rng, words, 30_000) for _ in range(150)]
    copies = []
    for line in base:
        w = line.split(" ")
        for k in rng.sample(range(words), edits):
            w[k] = f"word{rng.randrange(30_000)}"
        copies.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(base + copies)]
    removed = sum(r.n_removed for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert 0.9 * 150 <= removed <= 150


def test_long_lists_lose_no_link(spark, monkeypatch):
    """Pairs of similar lines in one list, which share no other block; lines of other pairs aren't similar."""
    rows = [(2 * i + k, " ".join([f"s{i}{c}" for c in "abcde"] + ["first", "second", "third", "fourth", "fifths", f"other{2 * i + k}"])) for i in range(10) for k in range(2)]
    for hot, splits in ((4, line_dedup.SPLITS), (1, 1)):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "SPLITS", splits)
        assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == {i: i % 2 for i, _ in rows}


def test_lines_that_cannot_be_similar_are_not_paired(spark, monkeypatch):
    """Lines of one list, of which the leader's pairs were written and verified whatever their words."""
    rows = [(i, " ".join([f"s{i}{c}" for c in "abcde"] + ["first", "second", "third", "fourth", "fifths", f"other{i}"])) for i in range(10)]
    plain, written = line_dedup.keep, []

    def counted(df, tag):
        kept = plain(df, tag)
        if tag in ("line-lists", "line-pairs"):
            written.append((tag, kept.count()))
        return kept

    monkeypatch.setattr(line_dedup, "keep", counted)
    assert line_dedup.dedup_lines(frame(spark, rows)).filter("n_removed > 0").isEmpty()
    assert all(n > 0 for tag, n in written if tag == "line-lists")
    assert {n for tag, n in written if tag == "line-pairs"} == {0}


def test_bitmaps_of_long_lines_tell_them_apart(spark):
    """Bits for words that are there at all were nearly all set in lines of 600 words."""
    rows = [(k, [f"{k}x{i}" for i in range(600)]) for k in range(2)]
    a, b = [r.w for r in spark.createDataFrame(rows, "k int, words array<string>").select("k", line_dedup._word_bitmaps(F.col("words")).alias("w")).orderBy("k").collect()]
    assert sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b)) > 32


def test_a_long_list_in_one_main_component_is_not_split(spark, monkeypatch):
    """20 lines of one component and two others, in a list above HOT: the others meet all, the 20 not one another."""
    monkeypatch.setattr(line_dedup, "HOT", 8)
    rows = [(1, k, max(0, k - 19), 1, 1, 1, 20, 22) for k in range(22)]
    pairs, hot = line_dedup._pairs(spark.createDataFrame(rows, "block long, h1 long, label long, bits long, w0 long, w1 long, size int, rows long"))
    assert hot.isEmpty() and sorted(map(tuple, pairs.collect())) == sorted([(k, j) for k in range(20) for j in (20, 21)] + [(20, 21)])


def test_lines_of_long_lists_are_verified_where_they_meet(spark, monkeypatch):
    """20 lines of one component and six others, alike by their signs: only what is similar makes a pair."""
    monkeypatch.setattr(line_dedup, "HOT", 25)
    letters = [chr(0x3400 + i) for i in range(2000)]
    norm = {k: "".join(letters[20 * k + i] for i in range(20)) for k in range(26)}
    norm[25] = norm[3][:18] + norm[25][18:]
    rows = [(1, k, max(0, k - 19), 1, 1, 1, 20, 26) for k in range(26)]
    texts = spark.createDataFrame(list(norm.items()), "h1 long, norm string")
    pairs, hot = line_dedup._pairs(spark.createDataFrame(rows, "block long, h1 long, label long, bits long, w0 long, w1 long, size int, rows long"), lambda led: texts)
    assert hot.isEmpty() and [tuple(r) for r in pairs.collect()] == [(3, 25)]


def test_two_lines_share_one_list(spark, monkeypatch):
    """Equal lists of two lines were kept once for each block that they have in common."""
    base = [f"word{k}x" for k in range(60)]
    plain, lists = line_dedup.keep, []

    def counted(df, tag):
        kept = plain(df, tag)
        if tag == "line-lists":
            lists.append(kept.count())
        return kept

    monkeypatch.setattr(line_dedup, "keep", counted)
    got = line_dedup.dedup_lines(frame(spark, [(1, " ".join(base)), (2, " ".join(["another", *base[1:]]))]))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 1} and lists == [1]


def test_a_pair_is_verified_once(spark, monkeypatch):
    """Two lines alike by all signs but not similar were verified with their list's smallest line, then once more as a pair of the list."""
    base = [f"word{k}x" for k in range(20)]
    plain, pairs = line_dedup.keep, []

    def counted(df, tag):
        kept = plain(df, tag)
        if tag == "line-pairs":
            pairs.append(kept.count())
        return kept

    monkeypatch.setattr(line_dedup, "keep", counted)
    got = line_dedup.dedup_lines(frame(spark, [(1, " ".join(base)), (2, " ".join(base[::-1]))]))
    assert {r.n_removed for r in got.collect()} == {0} and sum(pairs) == 1


def test_simhash_has_the_bits_of_most_hashes(spark):
    rng = random.Random(6)
    rows = [([rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)],) for n in (1, 2, 3, 4, 5, 6, 7) for _ in range(5)]
    h = F.col("h")
    got = spark.createDataFrame(rows, "h array<long>").select("h", line_dedup.simhash(F.size(h), lambda k: F.get(h, F.lit(k)), lambda: h).alias("sim")).collect()
    assert all((r.sim >> k & 1) == (2 * sum(x >> k & 1 for x in r.h) > len(r.h)) for r in got for k in range(64))


def test_short_lines_go_where_they_are_equal(spark):
    rows = [(1, "Read more\n\n***\n日本語の長い文章がここにあります。\nonly here"), (2, "read MORE!\n * * * \n\n日本語の長い文章がここにあります\n***\nread less"), (3, "Read more\nRead more\n  ")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows), short=True).collect()}
    assert got == {1: (rows[0][1], 5, 0), 2: (" * * * \n\nread less", 6, 3), 3: ("  ", 3, 2)}
    assert {r.n_removed for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == {0}


# Tokens


def test_encoder_equals_library():
    e = tokens.Encoder(tokens.tokenizer_json())
    rng = random.Random(3)
    parts = [" ", "\n", "a", "B", "é", ",", ".", "'s", "1", "  ", "\t", " ", "\x1c", "日", "×", "'ll", "<|endoftext|>", "\r", "-", "\x00", "᠎", " ", "word"]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(4000)), "x" * 50_000, prose(rng, 50_000)]
    ids, at = e.encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == e.tok.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("bits", [False, True])
def test_segments_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 50_000, 1000).astype("<u2")
    raw = token_planes.write_segment([5, 7], [400, 600], ids, bits, block=256)
    docs, first, sizes, back = token_planes.read_segment(raw)
    assert docs.tolist() == [5, 7] and first.tolist() == [0, 400] and sizes.tolist() == [400, 600] and (back == ids).all()
    with pytest.raises(Exception):
        token_planes.read_segment(raw[:-3])


def encoded(rows, end):
    tok = tokens.Encoder(tokens.tokenizer_json()).tok
    return {i: [*tok.encode(t or "", add_special_tokens=False).ids, end] for i, t in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_planes(spark):
    rows = corpus(3)
    want, start, expect = encoded(rows, 0), 0, {}
    for i, _ in rows:
        expect[i] = (start, len(want[i]), crc(want[i]))
        start += len(want[i])
    path = new_path(spark, "test")
    token_planes.write_tokens(odd(spark, rows).repartition(3), path, segment_ids=3000, block_ids=512)
    got = token_planes.read_tokens(spark, path, with_ids=True).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == expect and len(got) == len(rows)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] for r in got)
    assert token_planes.token_planes(frame(spark, [])).collect() == []
    some = token_planes.token_planes(frame(spark, [(None, "b"), (3, None), (3, "a")])).orderBy("start").collect()
    assert [r.doc_id for r in some] == [None, 3, 3] and [r.n_tokens for r in some] == [2, 1, 2]


def test_packing(spark):
    rows = corpus(4)
    want = encoded(rows, 1)
    got = [r for r in packing.pack(odd(spark, rows).repartition(4), window=256, with_ids=True).collect()]
    pieces, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and crc(ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in pieces.items()} == want
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(map(len, want.values()))
    assert len(sequences) <= 1.02 * total / 256 + 2
    assert packing.pack(frame(spark, [])).collect() == []


def test_fill_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 60)
        chosen = packing.fill(counts, room)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        assert all(n <= counts[k] for k, n in chosen.items()) and sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


# Languages


def test_languages(spark):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "ki", "ku"], "ab": ["ka", "ke", "ko"], "ba": ["strel", "sch", "ung"], "bb": ["strel", "tion", "ing"]}
    text = lambda v: " ".join("".join(rng.choices(sounds[v], k=3)) for _ in range(40))
    rows = [(i, text(v), v) for i, v in enumerate(itertools.islice(itertools.cycle(sounds), 400))] + [(900, None, "aa"), (901, "12 ½ ²", "aa"), (902, text("aa"), None), (903, "", "bb")]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, ~in_group("doc_id"))
    assert sorted(map(len, model["groups"])) == [2, 2] and all(len({model["names"][k][0] for k in g}) == 1 for g in model["groups"])
    got = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    assert [got[k].lang_pred for k in (900, 901, 903)] == ["und"] * 3 and got[900].score == 0
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == v for i, _, v in held]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    none = language_id.train(docs.filter("false"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    one = language_id.train(docs.filter("lang = 'aa'"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, one).collect()} == {"aa", "und"}


# WARC


def test_archives(spark):
    big, crlf = "x" * 99 + "é", "a\r\n\r\nb\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a/ b", big), (3, None, big), (9, "u", big), (4, "u", "tiny"), (6, "u", "tiny"), (7, "u", crlf), (8, "u", crlf), (10, "u", None), (11, "u", ""), (None, "u", big), (12, "u", "y" * 100_000)]
    got = warc.archive(frame(spark, rows, "page_id long, url string, html string").repartition(3)).collect()
    want = set()
    for page, _, html in rows:
        raw = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and (h or "") == (html or "")), default=None)
        later = len(raw) >= 100 and page is not None and first < page
        want.add((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", first if later else None))
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert warc.archive(frame(spark, [], "page_id long, url string, html string")).collect() == []


# Vectors


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64)).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 64), (2040, [float("nan")] * 64), (2060, [None] * 64), (2080, []), (None, [1.0] * 64), (2100, [1.0, 2.0])]
    got = ann.nearest(frame(spark, [*rows, *bad, rows[100]], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == [i for i in range(1500) if i % 20 == 0] and all(len(v) == 20 for v in by.values())
    wide, hits = x.astype(float), 0
    for q, found in by.items():
        score = np.array([sum(a * b for a, b in zip(wide[r.vec_id], wide[q])) for r in found])
        assert np.allclose([r.score for r in found], score, atol=1e-12, rtol=0)
        every = wide @ wide[q]
        every[q] = -9
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(1500), -np.round(every, 12)))[:20].tolist()))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert hits / (20 * len(by)) >= 0.93
    assert [r.vec_id for r in by[100]] == list(range(101, 121))
    few = ann.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(few, key=lambda r: r.rank)] == [(1, 1, 0.0), (2, 2, -1.0)]
    assert ann.nearest(frame(spark, [], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("lengths", ["equal", "lognormal", "outlier"])
def test_nearest_at_any_lengths(lengths):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= {"equal": np.ones((2000, 1)), "lognormal": rng.lognormal(0, 1, (2000, 1)), "outlier": np.where(np.arange(2000) == 7, 3.0, 1.0)[:, None]}[lengths]
    rows = pd.DataFrame({"vec_id": np.arange(2000), "embedding": list(x), "is_query": False})
    every = x @ x.T
    np.fill_diagonal(every, -np.inf)
    want = {q: set(np.argsort(-every[q])[:20].tolist()) for q in range(0, 2000, 40)}
    blocks = pd.concat([rows, rows[::40].assign(is_query=True)])
    assert ann._search(20, True)(blocks).groupby("query_id")["vec_id"].agg(set).to_dict() == want
    found = ann._search(20, False)(blocks)
    got = found.groupby("query_id")["vec_id"].agg(set)
    assert np.mean([len(got[q] & want[q]) / 20 for q in want]) >= 0.95
    # The index leaves out a part of the vectors, most of them where lengths differ much.
    assert found.groupby("query_id")["verified"].first().mean() < (1100 if lengths == "lognormal" else 1800)


def test_nearest_over_blocks(spark, monkeypatch):
    """Clustered vectors in several blocks, columns of the operator's own names: recall, and few vectors verified."""
    monkeypatch.setattr(ann, "BLOCK", 400)
    monkeypatch.setattr(ann, "QUERIES", 40)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 32))[rng.integers(0, 60, 1500)] + 0.05 * rng.standard_normal((1500, 32))
    rows = [(i, v.tolist(), 1, "b", 0.5) for i, v in enumerate(x)]
    got = ann.nearest(frame(spark, rows, "vec_id long, embedding array<double>, block int, dim string, score double"), F.col("vec_id") % 20 == 0).collect()
    every = x @ x.T
    np.fill_diagonal(every, -np.inf)
    hits = [every[r.query_id, r.vec_id] >= np.sort(every[r.query_id])[-20] - 1e-9 for r in got]
    assert len(got) == 75 * 20 and np.mean(hits) >= 0.95
    index = ann.Index(x, np.arange(1500))
    assert np.mean([verified for _, _, verified in index.nearest(x[::20], 20, np.arange(0, 1500, 20))]) < 500


# Toxicity


def test_toxicity(spark):
    rng = random.Random(7)
    text = lambda bad: " ".join([*(f"w{rng.randrange(3000)}" for _ in range(60)), *(rng.sample(["vile", "foul", "rotten", "nasty"], 2) if bad else [])])
    rows = [(i, text(i % 8 == 0), int(i % 8 == 0)) for i in range(800)] + [(900, None, None), (901, "", 0), (902, "vile rotten vile", None)]
    docs = frame(spark, [r[:2] for r in rows])
    labels = frame(spark, [(i, y) for i, _, y in rows] + [(None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, ~in_group("doc_id"))
    got = {r.doc_id: r for r in toxicity.score(docs, model, evidence=3).collect()}
    held = [(i, y) for i, _, y in rows[:800] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].predicted == y and 0 <= got[i].score <= 1 for i, y in held)
    assert got[902].predicted == 1 and got[900].predicted == got[901].predicted == 0
    assert all(e % 8 == 0 for e in got[902].evidence) and len(got[902].evidence) == 3
    empty = toxicity.learn(docs, labels.filter("false"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}


def dense(bags, weight):
    out = np.zeros((len(bags), len(weight)))
    for k, (t, c) in enumerate(bags):
        out[k, t] = (1 + np.log(c)) * weight[t]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@pytest.mark.parametrize("sizes", [(64, 1 / 16), (10, 2.0), (10, 0.02)])
def test_nearest_examples_are_exact(sizes, monkeypatch):
    """Lists of every kind, several blocks, bounds that skip some; against all cosines."""
    monkeypatch.setattr(toxicity, "FREQUENT", sizes[0])
    monkeypatch.setattr(toxicity, "COMMON", sizes[1])
    rng = np.random.default_rng(3)
    bags = []
    for k in range(1500):
        t = np.unique(np.minimum(rng.zipf(1.3, rng.integers(1, 30)), 400) - 1)
        bags.append((t, rng.integers(1, 4, len(t))))
    example, term, count = np.repeat(np.arange(1500), [len(t) for t, _ in bags]), *(np.concatenate(x) for x in zip(*bags))
    weight = 0.1 + rng.random(400) * (np.arange(400) % 7 == 0) * 5
    index = toxicity.Index(example, term, count, 1500, weight, rng.integers(0, 2, 1500))
    every = dense(bags, weight)
    asked = list(range(0, 1500, 17))
    for k, (best, cosine) in zip(asked, index.nearest_of([bags[k] for k in asked], 10, asked)):
        want = every @ every[k]
        want[k] = -1
        assert np.allclose(cosine, want[best], atol=1e-4) and np.allclose(cosine, np.sort(want)[::-1][: len(best)], atol=1e-4) and len(best) == 10


def test_toxicity_equals_brute_force(spark):
    """The whole operator against plain bags, weights, cosines, votes and steps."""
    rng = random.Random(17)
    text = lambda bad: " ".join([*(f"w{int(rng.paretovariate(0.5)) % 900}" for _ in range(rng.randrange(20, 90))), *(rng.sample(["vile", "foul", "rotten"], 2) if bad else [])])
    rows = [(i, text(i % 6 == 0), int(i % 6 == 0 or i % 29 == 0)) for i in range(500)]
    rows += [(600 + i, rows[i][1], 1 - rows[i][2]) for i in range(3)]
    docs, labels = frame(spark, [(*r[:2], "x", 5) for r in rows], "doc_id long, text string, toxic string, same int"), frame(spark, [(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, ~in_group("doc_id"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    train, seen = [], set()
    for i, t, y in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and t not in seen:
            seen.add(t)
            train.append((t.split(" "), y))
    words = sorted({w for t, _ in train for w in t})
    at = {w: k for k, w in enumerate(words)}
    bag = lambda t: tuple(np.array(x) for x in zip(*sorted((at[w], t.count(w)) for w in set(t) if w in at)))
    bags, y = [bag(t) for t, _ in train], np.array([y for _, y in train])
    df = np.bincount(np.concatenate([b[0] for b in bags]), minlength=len(words))
    bad = np.bincount(np.concatenate([b[0] for b, v in zip(bags, y) if v]), minlength=len(words))
    p, s = y.mean(), (bad + 10 * y.mean()) / (df + 10)
    weight = np.log((len(train) + 1) / (df + 0.5)) * (0.1 + np.log2(1 + np.maximum(s / (1 - s) * (1 - p) / p, 1)) - 1)
    every = dense(bags, weight)

    def vote(cosines):
        best = np.lexsort((np.arange(len(train)), -np.round(cosines, 5)))[:25]
        w = 1 / (1.05 - np.minimum(cosines[best], 1))
        return (w * y[best]).sum() / w.sum()

    product = every @ every.T
    np.fill_diagonal(product, -1)
    x, steps = toxicity.isotonic(np.array([vote(v) for v in product]), y)
    assert all(np.diff(steps) >= 0)
    close = [abs(got[i].score - min(max(np.interp(vote(dense([bag(t.split(" "))], weight)[0] @ every.T), x, steps), 0), 1)) for i, t, _ in rows]
    # Ties at the 25th place may fall otherwise where rounded sums differ.
    assert np.mean(np.array(close) < 1e-3) > 0.97 and len({round(r.score, 6) for r in got.values()}) > 20
    assert toxicity.score(docs.filter("false"), model).collect() == []


# Leaks


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randrange(12, 60)).capitalize() + ". " + prose(rng, 8) + ".") for k in range(40)] + [(90, None), (91, "too short"), (92, "w1 w2 w3 w4 w5")]
    rows = []
    for i in range(80):
        k = rng.randrange(40)
        item = items[k][1]
        if i % 4 == 1:
            item = item.upper()
        if i % 4 == 2:
            item = edited(rng, item, 1)
        rows.append((i, f"{prose(rng, rng.randrange(0, 200))} {item if i % 2 else ''} {prose(rng, 50)}"))
    rows += [(100, None), (101, ""), (None, items[3][1]), (102, items[5][1] + " " + prose(rng, 500) + " " + items[6][1]), (103, prose(rng, 20_000))]
    got = decontaminate.contaminated(odd(spark, rows).repartition(3), frame(spark, items, "item_id long, text string"))
    index = decontaminate.Index([x for x in items if x[1]])
    want = set()
    for i, t in rows:
        h = decontaminate._hashes(t or "")
        for k, item in enumerate(index.ids.tolist()):
            for a in range(0, max(1, len(h)), index.stride):
                s = decontaminate._shingles(h[a : a + 2 * index.stride])
                share = lambda x: np.isin(x, s).mean() if len(x) else 1.0
                if share(index.shingles[k]) >= 0.75 and min(share(index.question[k]), share(index.answer[k])) >= 0.5:
                    want.add((i, item))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == want and {(None, 3), (102, 5), (102, 6)} <= found and len(found) > 40
    assert decontaminate.contaminated(frame(spark, []), frame(spark, items, "item_id long, text string")).collect() == []
    assert decontaminate.contaminated(frame(spark, rows), frame(spark, [], "item_id long, text string")).collect() == []
    assert pd.DataFrame(got.collect(), columns=got.columns).score.ge(0).all()


def test_one_edit_voids_no_part_and_short_answers_count():
    rng = random.Random(11)
    held = lambda item, text: decontaminate.Index([(1, item)]).verify(decontaminate._hashes(text), 0)
    for n in (2, 5, 7, 9, 12):
        question, answer = prose(rng, 40, 4000), prose(rng, n, 4000).split(" ")
        item = f"{question}. {' '.join(answer)}."
        for k in range(n):
            assert held(item, f"{prose(rng, 9)} {question}. {' '.join(['other' if i == k else w for i, w in enumerate(answer)])}. {prose(rng, 9)}"), (n, k)
        # Another answer, even if the words of the right one come elsewhere in the passage.
        assert n > 9 or held(item, f"{question}. {prose(rng, n, 4000).replace('w', 'v')} {prose(rng, 30)} {' '.join(answer)}") is None
    assert held(f"{question}. Yes.", f"{question}. No. {prose(rng, 30)} yes") is None and held(f"{question}. Yes.", f"{question} yes")[3] == 1.0
