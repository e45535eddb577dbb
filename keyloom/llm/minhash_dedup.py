"""Near-duplicate documents: a signature-coordinate inverted join of MinHash signatures.

A document's set is its distinct five-word shingles (A-Z lower-cased; a shorter text is one shingle; a text without
words has none and is linked with nothing). Documents are linked when 100 * |A and B| >= 75 * |A or B|.

1. Signatures of 96 coordinates; documents with equal sets (by a 128-bit hash) become a class, and only its
   smallest doc_id goes on.
2. Each class is posted under (coordinate, value) pairs of the first 32 coordinates. Of these, 12 or more collide for
   a pair of similarity 0.75 (but for a probability of 2e-6), and two signatures with 12 collisions share one of the
   first 21 entries of any common order; so only this prefix is posted, entries that more than one in 10,000 documents
   hold last. Common passages are skipped so; their collisions are counted on the whole signatures of documents that
   meet elsewhere. Candidates are pairs with 52 of all 96 collisions (at similarity 0.75 fewer have a probability
   of 3e-6); where lists are merged, documents get longer signatures, 768 values of 8 bits, and candidates are pairs
   with 517 collisions there (probability of fewer at 0.75: 3e-7; pairs below 0.62 hardly pass).
3. Long lists aren't expanded into pairs. First each document meets only the list's leader, the one whose lists are longest; its best leader is
   verified on full sets, and the links are contracted. Lists that still hold several components are led once more, by
   another component's document, and contracted again. Then only lists that still hold several components are
   merged, in blocks of bounded size: collisions are counted block against block, and pairs from different
   components at 517 of 768 collisions or more are verified on full sets. A pair is
   counted in the list of its first common posted coordinate alone. Every candidate is thus either verified, or
   within one component already, which is all that components need.

Defined cases: null and empty texts: no shingles, own component; rows of null doc_id come back with null
component_id and kept false and link nothing; repeated doc_ids are judged row by row; ties go to the smaller
doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.bytetext import mix64, ragged, slices, words
from keyloom.llm.common import keep, lasting, release, released, row_key, scratch, sieve, sifted
from keyloom.llm.components import components

COORDINATES, MATCHES, POSTED, POSTED_MATCHES, SHINGLE = 96, 52, 32, 12, 5
LONG, LONG_MATCHES = 768, 517
#: Share of documents from which an entry is posted last; at most POSTED / HOT_SHARE entries.
HOT_SHARE = 1e-4
BLOCK = 512
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) + 0x7F4A7C15 * k * 2) % (1 << 64) | 1 for k in range(1, COORDINATES + 1)], np.uint64)


def shingle_sets(texts: list[str | None], width: int = SHINGLE):
    """Yields (first text, hashes of distinct shingles, number of each text) for slices of texts."""
    for i, j, data, starts in slices(texts):
        h, _, _, first = words(data, starts)
        count = np.diff(first)
        n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        at = np.repeat(first[:-1], n) + ragged(n)
        size = np.repeat(np.minimum(count, width), n)
        s = size.astype(np.uint64)
        for k in range(width):
            term = h[np.minimum(at + k, len(h) - 1)] * np.uint64(2 * k * 0x632BE59BD9B4E019 + 0xD1B54A32D192ED03 & ((1 << 64) - 1) | 1) if len(h) else s
            s = mix64(s + np.where(size > k, term, np.uint64(0)))
        ends = np.cumsum(n)
        sets = [np.unique(s[b - m : b]) for b, m in zip(ends.tolist(), n.tolist())]
        yield i, np.concatenate([*sets, s[:0]]), np.fromiter(map(len, sets), np.int64, len(sets))


def _sign(batches):
    for pdf in batches:
        for i, flat, n in shingle_sets(pdf["text"].tolist()):
            full = n > 0
            start = (np.cumsum(n) - n)[full]
            sig, sums = np.zeros((len(n), COORDINATES), "<u4"), np.zeros((2, len(n)), np.uint64)
            if len(start):
                for k in range(COORDINATES):
                    v = flat * _ODD[k]
                    v ^= v >> np.uint64(32)
                    v *= np.uint64(0xD6E8FEB86659FD93)
                    sig[full, k] = np.minimum.reduceat(v, start) >> np.uint64(32)
                for k, salt in enumerate((1, 2)):
                    sums[k, full] = np.add.reduceat(mix64(flat + np.uint64(salt)), start)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array[i : i + len(n)], "row_key": pdf["row_key"].array[i : i + len(n)], "n_shingles": n, "h1": sums[0].view(np.int64), "h2": sums[1].view(np.int64), "sig": [x.tobytes() for x in sig]})


def _extend(batches):
    """Longer signatures of 8-bit values."""
    for pdf in batches:
        for i, flat, n in shingle_sets(pdf["text"].tolist()):
            full = np.flatnonzero(n > 0)
            start = (np.cumsum(n) - n)[full]
            long = np.zeros((len(full), LONG), np.uint8)
            if len(start):
                for k in range(LONG):
                    v = flat * np.uint64((0x9E3779B97F4A7C15 * (4 * k + 3) + 0x632BE59BD9B4E019 * k * 2) % (1 << 64) | 1)
                    v ^= v >> np.uint64(32)
                    v *= np.uint64(0xA0761D6478BD642F)
                    long[:, k] = (np.minimum.reduceat(v, start) >> np.uint64(40)).astype(np.uint8)
            yield pd.DataFrame({"doc": pdf["row_key"].array.take(i + full), "long": [x.tobytes() for x in long]})


def _entries(sigs) -> np.ndarray:
    sig = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, COORDINATES)[:, :POSTED].astype(np.uint64)
    return mix64(sig | (np.arange(POSTED, dtype=np.uint64) << np.uint64(32)))


def _local_counts(share: float):
    def run(batches):
        seen, docs = [], 0
        for pdf in batches:
            docs += len(pdf)
            seen.append(_entries(pdf["sig"]).ravel())
        if docs:
            entry, n = np.unique(np.concatenate(seen), return_counts=True)
            often = n >= max(2, share * docs)
            yield pd.DataFrame({"entry": entry[often].view(np.int64), "n": n[often]})

    return run


def _post(hot):
    def run(batches):
        keys, counts = hot.value
        for pdf in batches:
            entry = _entries(pdf["sig"])
            n = np.zeros(entry.shape, np.int64)
            if len(keys):
                where = np.minimum(np.searchsorted(keys, entry), len(keys) - 1)
                n = np.where(keys[where] == entry, counts[where], 0)
            prefix = POSTED - POSTED_MATCHES + 1
            order = np.lexsort((entry, n), axis=1)[:, :prefix]
            mask = (np.uint64(1) << order.astype(np.uint64)).sum(1).astype(np.int64)
            yield pd.DataFrame({"entry": np.take_along_axis(entry, order, 1).ravel().view(np.int64), "doc": np.repeat(pdf["rep"].to_numpy(), prefix), "coordinate": order.ravel().astype(np.int32), "mask": np.repeat(mask, prefix)})

    return run


@F.pandas_udf(T.IntegerType())
def _collisions(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), "<u4").reshape(-1, COORDINATES) for s in (a, b))
    return pd.Series((x == y).sum(1).astype(np.int32))


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    out, known = [], ("", np.empty(0, np.uint64))
    for x, y in zip(a, b):
        if x != known[0]:
            known = (x, next(shingle_sets([x]))[1])
        z = next(shingle_sets([y]))[1]
        both = len(np.intersect1d(known[1], z, assume_unique=True))
        out.append(100 * both >= 75 * (len(known[1]) + len(z) - both) and both > 0)
    release()
    return pd.Series(out, dtype="bool")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. Only texts that pairs name are shuffled."""
    pairs = keep(pairs, "pairs")
    texts = sifted(docs, sieve(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))), "row_key").select("row_key", "text")
    a, b = texts.select(F.col("row_key").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("row_key").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").filter(_similar("text_a", "text_b")).select("a", "b")


def _cross(batches):
    """Pairs of different components at LONG_MATCHES collisions or more, from sorted blocks of a list."""
    rest = None

    def pairs(group):
        sig = np.frombuffer(b"".join(group["sig"]), "<u4").reshape(-1, POSTED)
        long = np.frombuffer(b"".join(group["long"]), np.uint8).reshape(-1, LONG)
        doc, label, side = group["doc"].to_numpy(), group["label"].to_numpy(), group["block"].to_numpy()
        posted, coordinate = (group["mask"].to_numpy()[:, None] >> np.arange(POSTED)) & 1 == 1, group["coordinate"].iat[0]
        one = group["b1"].iat[0] == group["b2"].iat[0]
        left = np.arange(len(doc)) if one else np.flatnonzero(side == group["b1"].iat[0])
        right = left if one else np.flatnonzero(side != group["b1"].iat[0])
        # Two documents collide in this list's coordinate; the pair counts here if in none of the posted ones before.
        first, second = (np.where(posted, sig, np.uint32(gap))[:, :coordinate] for gap in (0xFFFFFFFE, 0xFFFFFFFF))
        for a in range(0, len(left), 64):
            rows = left[a : a + 64]
            new = (label[rows][:, None] != label[right][None, :]) & ~(first[rows][:, None, :] == second[right][None, :, :]).any(2)
            x, y = np.nonzero(new & (doc[rows][:, None] < doc[right][None, :]) if one else new)
            near = np.concatenate([(long[rows[x[b : b + 4096]]] == long[right[y[b : b + 4096]]]).sum(1) >= LONG_MATCHES for b in range(0, len(x), 4096)] or [np.zeros(0, bool)])
            if near.any():
                p, q = doc[rows[x[near]]], doc[right[y[near]]]
                yield np.minimum(p, q), np.maximum(p, q)

    def done(frame):
        keys = frame[["entry", "b1", "b2"]].to_numpy()
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        found = [z for a, b in zip([0, *cut], [*cut, len(frame)]) for z in pairs(frame.iloc[a:b])]
        if found:
            yield pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = (pdf[["entry", "b1", "b2"]].to_numpy() == pdf[["entry", "b1", "b2"]].iloc[-1].to_numpy()).all(1) if len(pdf) else np.zeros(0, bool)
        rest = pdf[last]
        if not last.all():
            yield from done(pdf[~last])
    if rest is not None and len(rest):
        yield from done(rest)


def near_duplicates(docs: DataFrame, key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and row_key, of doc_id and text) for every row of docs(doc_id, text)."""
    with scratch(docs.sparkSession):
        found = lasting(_judged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row_key", row_key())), "near-duplicates")
    return found if key else found.drop("row_key")


def _led(docs: DataFrame, sigs: DataFrame, led: DataFrame) -> DataFrame:
    """Links (a, b) of documents with the best of the leaders that each is paired with, verified on full sets."""
    led = led.join(sigs.select(F.col("doc").alias("leader"), F.col("sig").alias("leader_sig")), "leader").join(sigs, "doc")
    led = led.withColumn("same", _collisions("leader_sig", "sig")).filter(F.col("same") >= MATCHES)
    best = led.groupBy("doc").agg(F.max(F.struct("same", "leader")).alias("best"))
    return _verified(docs, best.select(F.col("best.leader").alias("a"), F.col("doc").alias("b")))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of lists that hold several components."""
    mixed = rows.groupBy("entry").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("entry")
    return rows.join(mixed, "entry")


def _composed(found: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, component) of nodes by found, then of its components by joined."""
    every = found.select("node", "component").unionByName(joined.select("node").join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
    then = joined.select(F.col("node").alias("component"), F.col("component").alias("final"))
    return every.join(then, "component", "left").select("node", F.coalesce("final", "component").alias("component"))


def _judged(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    signed = keep(docs.mapInPandas(released(_sign), "doc_id long, row_key long, n_shingles long, h1 long, h2 long, sig binary"), "signatures")
    with_set = signed.filter("n_shingles > 0 and doc_id is not null")
    # A class goes by the row of its smallest doc_id: other texts may have that id too.
    classes = with_set.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row_key", "sig")).alias("least"))
    reps = keep(classes.select("h1", "h2", F.col("least.row_key").alias("rep"), F.col("least.doc_id").alias("rep_doc"), F.col("least.sig").alias("sig")), "classes")

    n = reps.count()
    often = reps.select("sig").mapInPandas(released(_local_counts(HOT_SHARE)), "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(8, HOT_SHARE * n))
    often = often.toPandas().sort_values("entry", key=lambda s: s.to_numpy().view(np.uint64))
    hot = spark.sparkContext.broadcast((often["entry"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)))

    postings = reps.select("rep", "sig").mapInPandas(released(_post(hot)), "entry long, doc long, coordinate int, mask long")
    lists = postings.groupBy("entry").agg(F.count("*").alias("size")).filter("size > 1")
    lists = keep(postings.join(lists, "entry"), "lists")
    # A list is led by the document whose lists are longest: of a text and its edited copies that is the text, which is
    # more like each copy than they are like each other.
    hubs = lists.groupBy("doc").agg(F.sum("size").alias("hub"))
    lists = keep(lists.join(hubs, "doc"), "led")
    first = lists.groupBy("entry").agg(F.max(F.struct("hub", "doc")).alias("x")).select("entry", F.col("x.doc").alias("leader"))

    sigs = reps.select(F.col("rep").alias("doc"), "sig")
    found = components(_led(docs, sigs, lists.join(first, "entry").filter("doc != leader").select("leader", "doc").distinct()))

    labelled = lists.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("entry", "size", "doc", "hub", "coordinate", "mask", F.coalesce("component", "doc").alias("label"))
    labelled = keep(_mixed(labelled), "labelled")
    # Lists that still hold several components are led once more, by the next such document outside of the first's component.
    of_first = labelled.join(first, "entry").filter("doc = leader").select("entry", F.col("label").alias("first_label"))
    again = labelled.join(of_first, "entry").filter("label != first_label").groupBy("entry").agg(F.max(F.struct("hub", "doc", "label")).alias("x")).select("entry", F.col("x.doc").alias("leader"), F.col("x.label").alias("leader_label"))
    links = _led(docs, sigs, labelled.join(again, "entry").filter("label != leader_label").select("leader", "doc").distinct())
    label = lambda c: labelled.select(F.col("doc").alias(c), F.col("label").alias(f"l{c}")).distinct()
    joined = components(links.join(label("a"), "a").join(label("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    found = keep(_composed(found, joined), "found")
    rows = labelled.join(joined.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
    rows = keep(_mixed(rows), "mixed")
    blocks = F.ceil(F.col("size") / BLOCK)
    long = sifted(docs, sieve(rows.select("doc")), "row_key").mapInPandas(released(_extend), "doc long, long binary")
    long = keep(sigs.select("doc", F.substring("sig", 1, 4 * POSTED).alias("sig")).join(long, "doc"), "long-signatures")
    rows = rows.join(long, "doc").withColumn("block", F.pmod(F.xxhash64("doc"), blocks).cast("long"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
    rows = rows.select("entry", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "doc", "label", "coordinate", "mask", "sig", "long")
    rows = rows.repartition("entry", "b1", "b2").sortWithinPartitions("entry", "b1", "b2")
    more = _verified(docs, rows.mapInPandas(released(_cross), "a long, b long"))
    label = found.select(F.col("node").alias("id"), "component")
    links = more.join(label.withColumnRenamed("id", "a").withColumnRenamed("component", "ca"), "a", "left").join(label.withColumnRenamed("id", "b").withColumnRenamed("component", "cb"), "b", "left")
    merged = components(links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))

    first = found.select(F.col("node").alias("rep"), F.col("component").alias("middle"))
    of_rep = reps.select("h1", "h2", "rep", "rep_doc").join(first, "rep", "left").withColumn("middle", F.coalesce("middle", "rep"))
    of_rep = of_rep.join(merged.select(F.col("node").alias("middle"), F.col("component").alias("final")), "middle", "left").select("h1", "h2", "rep_doc", F.coalesce("final", "middle").alias("found"))
    lowest = of_rep.groupBy("found").agg(F.min("rep_doc").alias("component_id"))
    of_rep = of_rep.join(lowest, "found").select("h1", "h2", "component_id")
    grouped = with_set.select("doc_id", "row_key", "n_shingles", "h1", "h2").join(of_rep, ["h1", "h2"]).select("doc_id", "row_key", "n_shingles", "component_id")
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "row_key")
