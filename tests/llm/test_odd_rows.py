"""Names that clash, repeated rows and ids, empty tables, very long texts, many languages, many pages."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import chat_format, common, decontaminate, language_id, line_dedup, minhash_dedup, packing, token_planes, tokens, toxicity, warc
from tests.llm.texts import components, prose, shingles

CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_lines int, N_REMOVED int, row_key int, `_ld_x` string, kept int, entry string"


def clashing(rows):
    return [(i, t, "en" if (i or 0) % 2 else "fr", "s", len(t or ""), 0.5, "x", 1, 2, 3, "y", 4, "e") for i, t in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rng = random.Random(31)
    words = lambda n: prose(rng, n, 5000).replace("w", "word")
    x, y, z = words(80), words(80), words(120)
    rows = [(1, x), (5, x + " more"), (5, y), (5, y), (7, None), (None, z), (8, ""), (9, words(60_000)), *((k, words(50)) for k in range(20, 60))]
    spark.createDataFrame(clashing(rows), CLASH).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, words(30))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows


def test_pipeline_with_clashing_names_and_repeated_ids(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.keep(stage(spark, docs, folder), name)
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
    left = [(r.doc_id, r.text) for r in docs.collect()]
    texts = {t for _, t in left}
    # (1, X) stays for (5, X more); (5, Y) is another document with that id, whose copies lose their lines alike.
    assert (1, rows[0][1]) in left and not any(t == rows[1][1] for _, t in left) and (5, rows[2][1]) in left
    assert (None, rows[5][1]) in left and rows[7][1] in texts and not {None, ""} & texts
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_two_runs_side_by_side(spark, tables):
    """The tables that a result reads outlive another run's."""
    folder, _ = tables
    first = corpus_pipeline.run(spark, folder)
    second = corpus_pipeline.run(spark, folder)
    assert first.count() == second.count()


def test_operators_take_any_names_and_no_rows(spark):
    rows = [(1, "eins zwei drei vier fünf sechs"), (1, "eins zwei drei vier fünf sechs"), (2, None), (3, ""), (None, "a b c d e f")]
    docs = spark.createDataFrame(clashing(rows), CLASH)
    for df in (docs, docs.filter("false")):
        n = df.count()
        assert minhash_dedup.near_duplicates(df).count() == n and line_dedup.dedup_lines(df, short=True).count() == n
        assert token_planes.token_planes(df).count() == n and packing.pack(df).count() == n
        model = language_id.train(df, F.lit(True))
        assert language_id.identify(df, model).columns == ["doc_id", "lang_pred", "score"] and language_id.identify(df, model).count() == n
        toxic = toxicity.learn(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"), F.lit(True))
        scored = toxicity.score(df, toxic)
        assert scored.columns == ["doc_id", "score", "predicted"] and scored.count() == n
        assert decontaminate.contaminated(df, spark.createDataFrame([(1, "eins zwei drei vier fünf sechs")], "item_id long, text string")).count() == (2 if n else 0)
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string, source string, first int, rows int")
    assert chat_format.format_chats(chats).collect() == []
    long = spark.createDataFrame([(1, 1, "user", "<|im_end|>" + "ab " * 400_000, "s", 1, 2)], chats.schema)
    found = chat_format.format_chats(long).first()
    assert found.round_trip and found.turns[0].text == "<|im_end|>" + "ab " * 400_000


def test_one_very_long_text(spark):
    rng = random.Random(3)
    text = "\n".join(prose(rng, 40, 20_000) for _ in range(4000))
    docs = spark.createDataFrame([(1, text), (2, text + " w1"), (3, "kurz")], "doc_id long, text string")
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got[2].component_id == 1 and got[1].n_shingles == len(shingles(text))
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[1].n_removed == 0 and lines[2].n_removed == 4000
    tok = tokens.Encoder(tokens.tokenizer_json()).tok
    assert {r.doc_id: r.n_tokens for r in token_planes.token_planes(docs).collect()}[1] == len(tok.encode(text, add_special_tokens=False).ids) + 1


def test_every_language_is_learned(spark):
    """150 languages, one of them rare; none starves."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sounds = {f"l{k:03d}": ["".join(rng.choices(letters, k=3)) for _ in range(4)] for k in range(150)}
    text = lambda v: " ".join("".join(rng.choices(sounds[v], k=2)) for _ in range(30))
    rows = [(i, text(v), v) for i, v in enumerate([v for v in sounds for _ in range(4 if v == "l000" else 14)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert model["names"] == sorted(sounds)
    fresh = spark.createDataFrame([(k, text(v)) for k, v in enumerate(sounds)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(fresh, model).collect()}
    assert np.mean([got[k] == v for k, v in enumerate(sounds)]) > 0.9


def test_many_pages_big_ones_and_repeated_ids(spark, tmp_path, monkeypatch):
    """Files of bounded bytes, more pages than a file has, equal rows of one id."""
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = [(k, "u", f"page {k % 4000} " + "x" * 120) for k in range(4500)] + [(9000, "u", "y" * 700_000), (9001, "u", "z" * 900_000), (9001, "u", "z" * 900_000), (9002, "u", "y" * 700_000)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, k int, digest string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "a"))
    files = [f for f in (tmp_path / "a").iterdir() if f.name.endswith(".gz")]
    import gzip

    assert len(files) > 3 and max(len(gzip.decompress(f.read_bytes())) for f in files) < 4 << 20
    got = sorted(tuple(r) for r in warc.read_archives(spark, str(tmp_path / "a")).collect())
    want = []
    for page, _, html in rows:
        first = min(p for p, _, h in rows if h == html) if page >= 4000 or page < 500 else page
        want.append((page, len(html), hashlib.sha256(html.encode()).hexdigest(), "revisit" if first < page else "response"))
    assert [g[:4] for g in got] == sorted(want)


def test_short_items_are_held_whole(spark):
    items = spark.createDataFrame([(1, "is two plus"), (2, "Yes"), (3, "zwei Wörter")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "What is two plus two?"), (2, "two is plus, is it"), (3, "yes"), (4, "ZWEI Wörter."), (5, "Wörter zwei")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()) == [(1, 1), (4, 3)]


def test_benchmark_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 10)
    rng = random.Random(6)
    texts = [prose(rng, 20, 3000) + ". " + prose(rng, 8, 3000) for _ in range(35)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(k, prose(rng, 50, 3000) + " " + t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()) == [(k, k) for k in range(35)]


def test_lists_above_a_block(spark):
    """Documents with a common passage, in lists longer than BLOCK, against brute force."""
    rng = random.Random(8)
    passage = prose(rng, 90, 4000)
    rows = [(i, f"{prose(rng, rng.randrange(8, 40), 4000)} {passage}") for i in range(700)]
    rows += [(1000 + i, rows[i][1] + " w1") for i in range(0, 700, 9)]
    sets = {i: shingles(t) for i, t in rows}
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == components(ids, links) and len(links) > 500 and minhash_dedup.BLOCK < 700


def test_settings_and_folders(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    path = common.keep(spark.range(3), "x").inputFiles()[0]
    with common.scratch(spark):
        inner = common.keep(spark.range(5), "y")
        kept = common.lasting(spark.range(7), "z")
        gone = inner.inputFiles()[0].removeprefix("file://")
    import os

    assert spark.conf.get(key) == before and kept.count() == 7 and os.path.exists(path.removeprefix("file://")) and not os.path.exists(gone)


def test_held_out_scores_are_functions_of_text(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, prose(rng, 40, 800) + (" vile foul" if i % 7 == 0 else "")) for i in range(300)] + [(1000, "vile foul w1 w2"), (1001, "vile foul w1 w2")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, labels, ~common.in_group("doc_id"))).collect()}
    assert got[1000] == got[1001] > 0.3
