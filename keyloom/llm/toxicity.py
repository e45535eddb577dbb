"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Texts are bags of words (runs of letters and digits, A-Z lower-cased, by 64-bit hash). From a bounded sample of labelled
documents (equal texts once) every word is a term and every document an example. Weights are (1 + log tf) * idf * mark,
at unit length, where mark is BASE plus a word's lift: the logarithm of how many times likelier a word is among toxic
examples than on the whole, shrunk towards none where few examples have the word. So words that mark toxic texts outweigh
the topic where there are any; other texts have neighbours, votes and evidence by their common words.

Examples are in blocks by their number of words. The inverted index has lists of rare words, whose scores are summed at
once; lists of frequent words by block, each with the block's largest weight; and rows of the most frequent words, which most
examples have, as plain arrays. Blocks come in descending order of their upper bounds, and those whose bound doesn't
reach the k-th best cosine are skipped: the nearest examples are exact. They vote with weights that fall with their
distance; votes are calibrated by isotonic regression on the votes that each example gets from the others. The
examples that voted are the evidence. A text without any known word gets the share of toxic examples.

Learned from at most SAMPLE labelled rows, drawn by a hash of doc_id; the index has a fixed bound therefore and is
broadcast. Scores are functions of text alone.

Defined cases: null and empty texts count as texts without words; where nothing was learned, or only one label, every score
is the share of toxic examples (0 without any); of several labels for a doc_id the highest counts, and of several texts the one
that comes first by hash; null labels are left out; ties between examples go to the smaller number in the index's order;
repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bytetext import ragged, slices, words
from keyloom.llm.common import keep, lasting, released, scratch, shrink_driver

SAMPLE, NEIGHBOURS, BLOCK, THRESHOLD = 20_000, 25, 256, 0.3
#: The mark of words that don't lean to toxic texts; examples that a word's share is shrunk by.
BASE, SHRINK = 0.1, 10
#: Examples from which a word is frequent and has block maxima; share of examples from which its row is an array.
FREQUENT, COMMON = 64, 1 / 16


def bags(texts: list[str | None]):
    """Yields (first text, texts, text of each distinct word, word's hash, count) for slices of texts, in order of text and hash."""
    for i, j, data, starts in slices(texts):
        h, _, _, first = words(data, starts, alnum=True)
        text = np.repeat(np.arange(j - i), np.diff(first))
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        yield i, j - i, text[at], h[at], np.diff(np.append(at, len(h)))


def _gather(batches):
    """Words and counts of labelled texts."""
    for pdf in batches:
        for i, n, text, h, count in bags(pdf["text"].tolist()):
            cut = np.searchsorted(text, np.arange(n + 1))
            cells = [(h[a:b].tobytes(), count[a:b].astype("<i4").tobytes()) for a, b in zip(cut, cut[1:])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[i : i + n].to_numpy(), "toxic": pdf["toxic"].iloc[i : i + n].to_numpy(), "words": [c[0] for c in cells], "counts": [c[1] for c in cells]})


def weights(term: np.ndarray, label: np.ndarray, terms: int, n: int, share: float) -> np.ndarray:
    """idf * mark of each term, from one entry of term (and the example's label) for each example that has it."""
    df, bad = np.bincount(term, minlength=terms), np.bincount(term, label, terms)
    s = (bad + SHRINK * share) / (df + SHRINK)
    ratio = s / np.maximum(1 - s, 1e-9) * (1 - share) / max(share, 1e-9)
    return np.log((n + 1) / (df + 0.5)) * (BASE + np.log2(1 + np.maximum(ratio, 1)) - 1)


class Index:
    """Block-max inverted index of examples in order: for each entry, example, term and count, by example."""

    def __init__(self, example: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, weight: np.ndarray, labels: np.ndarray):
        self.n, self.labels, self.weight = n, labels.astype(np.float64), weight.astype(np.float32)
        self.blocks = max(1, -(-n // BLOCK))
        df = np.bincount(term, minlength=len(weight))
        w = np.log(count, dtype=np.float32)
        w += 1
        w *= self.weight[term]
        first = np.searchsorted(example, np.arange(n + 1))
        length = np.array([np.sqrt(np.dot(w[a:b], w[a:b])) for a, b in zip(first, first[1:])], np.float32)
        w /= np.maximum(length, 1e-12)[example]
        # Terms by kind, and the number of a frequent or common term among its kind.
        self.kind = np.where(df < FREQUENT, 0, np.where(df < max(COMMON * n, FREQUENT), 1, 2)).astype(np.int8)
        self.row = np.where(self.kind == 2, np.cumsum(self.kind == 2) - 1, np.cumsum(self.kind == 1) - 1).astype(np.int32)
        self.common, common = np.zeros((int((self.kind == 2).sum()), self.blocks * BLOCK), np.float32), self.kind[term] == 2
        self.common[self.row[term[common]], example[common]] = w[common]
        term, example, w = term[~common], example[~common], w[~common]
        order = np.argsort(term, kind="stable").astype(np.int32)
        self.doc, self.w = example[order], w[order]
        self.at = np.concatenate([[0], np.cumsum(np.where(self.kind == 2, 0, df))]).astype(np.int32)
        frequent, edges = np.flatnonzero(self.kind == 1), np.arange(self.blocks + 1) * BLOCK
        self.most, self.cuts = np.zeros((len(frequent), self.blocks), np.float32), np.zeros((len(frequent), self.blocks + 1), np.int32)
        for k, t in enumerate(frequent):
            a, b = self.at[t], self.at[t + 1]
            np.maximum.at(self.most[k], self.doc[a:b] // BLOCK, self.w[a:b])
            self.cuts[k] = a + np.searchsorted(self.doc[a:b], edges)

    def vector(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.weight[term]
        return (w / max(np.sqrt((w**2).sum()), 1e-12)).astype(np.float32)

    def _lists(self, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What the entries of lists lo to hi, weighted by q, give each example."""
        n = hi - lo
        at = np.repeat(lo, n) + ragged(n)
        return np.bincount(self.doc[at], np.repeat(q, n) * self.w[at], self.blocks * BLOCK).astype(np.float32)

    def nearest_of(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None):
        """Yields (examples, cosines) of the k nearest with a cosine above zero, nearest first, of each text (terms, counts)."""
        for a in range(0, len(texts), 32):
            part = texts[a : a + 32]
            vectors = [self.vector(*x) for x in part]
            asked = np.zeros((len(part), len(self.common)), np.float32)
            for i, ((term, _), q) in enumerate(zip(part, vectors)):
                some = self.kind[term] == 2
                asked[i, self.row[term[some]]] = q[some]
            # The arrays of the words that most examples have, for several texts at once.
            scores = asked @ self.common
            for i, ((term, _), q) in enumerate(zip(part, vectors)):
                yield self._nearest(term, q, scores[i], k, but[a + i] if but else -1)

    def _nearest(self, term: np.ndarray, q: np.ndarray, score: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        kind = self.kind[term]
        rare, frequent = term[kind == 0], term[kind == 1]
        score += self._lists(self.at[rare], self.at[rare + 1], q[kind == 0])
        q, lists, by_block = q[kind == 1], self.row[frequent], score.reshape(self.blocks, BLOCK)
        if but >= 0:
            score[but] = -1
        if len(lists):
            bound = by_block.max(1) + q @ self.most[lists]
            left, low = np.argsort(-bound, kind="stable"), 0.0
            while len(left):
                # The best block first, then all that may still hold one of the k nearest: few, or most of them.
                now = left[:1] if low == 0.0 and self.blocks > 1 else left
                if 2 * len(now) > self.blocks:
                    more = self._lists(self.cuts[lists, 0], self.cuts[lists, -1], q).reshape(self.blocks, BLOCK)[now]
                    by_block[now] += more
                else:
                    for block in now.tolist():
                        lo, hi = self.cuts[lists, block], self.cuts[lists, block + 1]
                        n = hi - lo
                        at = np.repeat(lo, n) + ragged(n)
                        by_block[block] += np.bincount(self.doc[at] - block * BLOCK, np.repeat(q, n) * self.w[at], BLOCK).astype(np.float32)
                if but >= 0:
                    score[but] = -1
                left = left[len(now) :]
                if low == 0.0 and len(left):
                    first = by_block[now[0]]
                    low = max(float(np.partition(first, BLOCK - k)[BLOCK - k]), 1e-9)
                    by_block[left[bound[left] < low - 1e-5]] = 0
                    left = left[bound[left] >= low - 1e-5]
        score = score[: self.n]
        some = np.flatnonzero(score >= max(np.partition(score, self.n - k)[self.n - k] - 1e-5, 1e-9)) if self.n > k else np.flatnonzero(score > 1e-9)
        some = some[np.lexsort((some, -np.round(score[some], 5)))[:k]]
        return some, score[some].astype(np.float64)

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None):
        """Yields (share of weight on toxic examples or -1 without any, the examples) of each text."""
        for best, cosine in self.nearest_of(texts, NEIGHBOURS, but):
            w = 1 / (1.05 - np.minimum(cosine, 1.0))
            yield (float((w * self.labels[best]).sum() / w.sum()) if len(best) else -1.0), best


def known(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term of each hash, whether it is in the sorted vocabulary)."""
    if not len(vocabulary):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    term = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return term, vocabulary[term] == h


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best non-decreasing step function of x for y, as (mean x, value) of its steps, to be interpolated."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []  # sum of y, number, sum of x, least x, largest x
    for v, t in zip(x[order].tolist(), y[order].tolist()):
        stack.append([t, 1.0, v, v, v])
        while len(stack) > 1 and (stack[-2][0] / stack[-2][1] >= stack[-1][0] / stack[-1][1] or stack[-2][4] == stack[-1][3]):
            s, n, total, _, high = stack.pop()
            low = stack[-1]
            stack[-1] = [low[0] + s, low[1] + n, low[2] + total, low[3], high]
    return np.array([s[2] / s[1] for s in stack]), np.array([(s[0] + 0.5) / (s[1] + 1) if s[1] > 1 else s[0] for s in stack])


def _build(found: pd.DataFrame, share: float) -> dict:
    """The model of examples(doc_id, toxic, words, counts), which it empties: a driver has little memory."""
    sizes = found["words"].map(len).to_numpy() // 8
    order = np.lexsort((found["doc_id"].to_numpy(), sizes))
    labels, ids, sizes, n = found["toxic"].to_numpy(np.int64)[order], found["doc_id"].to_numpy(np.int64)[order], sizes[order], len(found)
    take = lambda name, dtype: np.frombuffer(b"".join(found.pop(name).to_numpy()[order]), dtype)
    h = take("words", "<u8")
    vocabulary = np.sort(h)
    vocabulary = vocabulary[np.flatnonzero(np.concatenate([[True], vocabulary[1:] != vocabulary[:-1]]))]
    term = np.empty(len(h), np.int32)
    for a in range(0, len(h), 1 << 18):
        term[a : a + (1 << 18)] = np.searchsorted(vocabulary, h[a : a + (1 << 18)])
    del h
    count, example = take("counts", "<i4"), np.repeat(np.arange(n, dtype=np.int32), sizes)
    weight = weights(term, labels[example], len(vocabulary), n, share)
    return {"vocabulary": vocabulary, "ids": ids, "index": Index(example, term, count, n, weight, labels)}


def learn(docs: DataFrame, labels: DataFrame, training) -> dict:
    """The model: vocabulary, index of examples, calibration. training selects rows of labels(doc_id, toxic)."""
    spark = docs.sparkSession
    marked = labels.filter(training & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = marked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).drop("id")
    with scratch(spark):
        # One text an id, equal texts once: SAMPLE rows at most, whatever repeats.
        named = keep(rows.withColumn("same", F.xxhash64("text")), "labelled-rows")
        first = named.groupBy("doc_id").agg(F.min("same").alias("same")).groupBy("same").agg(F.min("doc_id").alias("doc_id"))
        texts = named.join(first, ["doc_id", "same"]).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
        bagged = keep(texts.mapInPandas(released(_gather), "doc_id long, toxic int, words binary, counts binary"), "labelled-bags")
        shrink_driver(spark)
        found = bagged.toPandas()
        share = float(found["toxic"].mean()) if len(found) else 0.0
        if not 0 < share < 1:
            return {"share": share, "shipped": None, "x": np.empty(0), "y": np.empty(0)}
        shrink_driver(spark)
        shipped = spark.sparkContext.broadcast(_build(found, share))
        del found

        def votes(batches):
            model = shipped.value
            number = {int(d): k for k, d in enumerate(model["ids"])}
            for pdf in batches:
                texts = [(np.searchsorted(model["vocabulary"], np.frombuffer(h, "<u8")), np.frombuffer(c, "<i4")) for h, c in zip(pdf["words"], pdf["counts"])]
                found = [v for v, _ in model["index"].votes(texts, [number[d] for d in pdf["doc_id"].tolist()])]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "vote": found})

        dealt = bagged.repartition(max(spark.sparkContext.defaultParallelism, 1), "doc_id")
        voted = keep(dealt.mapInPandas(released(votes), "doc_id long, toxic int, vote double"), "votes").toPandas().sort_values("doc_id")
    voted = voted[voted["vote"] >= 0]
    x, y = isotonic(voted["vote"].to_numpy(), voted["toxic"].to_numpy())
    return {"share": share, "shipped": shipped, "x": x, "y": y}


def judge(index: Index, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
    """(vote, examples that voted) of texts with these known words and counts; equal ones are judged once."""
    out: list = [(-1.0, np.empty(0, np.int64))] * len(texts)
    same: dict[tuple[bytes, bytes], list[int]] = {}
    for i, (term, count) in enumerate(texts):
        if len(term):
            same.setdefault((term.tobytes(), count.tobytes()), []).append(i)
    for rows, found in zip(same.values(), index.votes([texts[rows[0]] for rows in same.values()])):
        for i in rows:
            out[i] = found
    return out


def score(docs: DataFrame, model: dict, evidence: int = 0) -> DataFrame:
    """doc_id, score, predicted (and evidence: doc_ids of so many nearest examples) for each row of docs(doc_id, text)."""
    shipped, share, x, y = model["shipped"], model["share"], model["x"], model["y"]

    def run(batches):
        learned = shipped.value if shipped and len(x) else None
        for pdf in batches:
            for i, n, text, h, count in bags(pdf["text"].tolist()):
                found = [(-1.0, np.empty(0, np.int64))] * n
                if learned:
                    term, real = known(learned["vocabulary"], h)
                    text, term, count = text[real], term[real], count[real]
                    cut = np.searchsorted(text, np.arange(n + 1))
                    found = judge(learned["index"], [(term[a:b], count[a:b]) for a, b in zip(cut, cut[1:])])
                votes = np.array([v for v, _ in found])
                scores = np.where(votes >= 0, np.interp(votes, x, y), share) if learned else np.full(n, share)
                out = pd.DataFrame({"doc_id": pdf["doc_id"].array[i : i + n], "score": np.clip(scores, 0.0, 1.0)})
                out["predicted"] = (out["score"] >= THRESHOLD).astype("int32")
                if evidence:
                    out["evidence"] = [learned["ids"][best[:evidence]].tolist() if learned else [] for _, best in found]
                yield out

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(released(run), "doc_id long, score double, predicted int" + ", evidence array<long>" * bool(evidence))
    return lasting(found, "toxicity")
