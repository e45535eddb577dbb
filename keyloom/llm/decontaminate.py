"""Benchmark decontamination with BM25 and block-max WAND.

Test items are the documents of an inverted index; every passage of every training text is a query. Words are runs of
letters and digits (A-Z lower-cased). Passages are windows of twice the longest item (64 words at least), half
overlapping, so that any copy of an item lies within one. An item's threshold is the least BM25 score that a passage
can have if it holds 75 % of the item's five-word shingles: its full score less the largest impacts of as many words as
may then be missing. All passages at or above it are retrieved: words whose impacts together stay below the threshold
can't reach it alone, so candidates come from the others' postings only, first in blocks of items by block maxima, then
by item; what may still reach the threshold gets its full score. Then overlap is verified: 75 % of the item's distinct five-word
shingles lie in the passage, and half of those that begin in its question (all sentences but the last) and of those that end in
its answer (the last; of a single sentence, its last third). One changed word takes up to five shingles with it, so a
part of fewer than ten is compared word by word instead: half of its words lie, in their order, in the stretch of the
passage where the item's other shingles place the part.

Items of two to four words are held where their whole sequence of words is.

The index is broadcast in shards of at most SHARD items, one at a time; a larger benchmark takes several scans. Nothing
is shuffled.

Defined cases: items that are null or have fewer than two words can't be told from chance and match nothing;
null and empty texts match nothing; a row of null doc_id is judged and reported with null; repeated rows are reported
each; of equal passages the first counts; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bytetext import mix64, ragged, slices, words
from keyloom.llm.common import keep, lasting, released, row_key, scratch

SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.75, 0.5
SHARD, BLOCK, K1, B = 20_000, 16, 1.2, 0.75
LEAST_WORDS = 2
RESULT = "doc_id long, item_id long, score double, threshold double, overlap double, question_overlap double, answer_overlap double, first_word long, last_word long, row_key long"


_PRESENT = 1 << 22


def _slot(cell: np.ndarray) -> np.ndarray:
    return (mix64(cell.astype(np.uint64)) & np.uint64(_PRESENT - 1)).astype(np.int64)


def _hashes(text: str) -> np.ndarray:
    _, _, data, starts = next(slices([text]))
    return words(data, starts, alnum=True)[0]


def _shingles(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    s = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        s = mix64(s + h[k : len(h) - width + 1 + k] * np.uint64((2 * k + 1) * 0x632BE59BD9B4E019 & ((1 << 64) - 1) | 1)) if len(s) else s
    return s


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence; a row of its table is the bits of an integer."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b.tolist():
        both = row & at.get(y, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def _in_place(item: np.ndarray, a: int, b: int, passage: np.ndarray, held: np.ndarray) -> float:
    """The share of the item's words a to b that lie, in order, where its shingles place them in the passage (held: its shingles)."""
    places = np.argsort(held, kind="stable")
    own = _shingles(item)
    at = np.searchsorted(held[places], own)
    some = np.flatnonzero((at < len(held)) & (held[places][np.minimum(at, len(held) - 1)] == own))
    outer = some[(some < a) | (some + SHINGLE > b)]
    some = outer if len(outer) else some
    shift = places[at[some]] - some
    # The shingles next to the part; changed words move it by a few places.
    near = shift[np.argsort(np.maximum(np.maximum(a - some, some + SHINGLE - b), 0), kind="stable")[:SHINGLE]]
    low, high = max(a + int(near.min()) - SHINGLE, 0), max(b + int(near.max()) + SHINGLE, 0)
    return _common(item[a:b], passage[low:high]) / (b - a)


class Index:
    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, t, h) for i, t in sorted(items) if len(h := _hashes(t)) >= LEAST_WORDS]
        self.ids = np.array([i for i, _, _ in kept], np.int64)
        self.shingles, self.question, self.answer, self.parts = [], [], [], []
        for _, t, h in kept:
            cuts = [len(_hashes(t[: m.end()])) for m in re.finditer(r"[.!?]+\s+", t.rstrip())]
            split = max((c for c in cuts if 0 < c < len(h)), default=len(h) - max(1, len(h) // 3))
            s = _shingles(h, min(len(h), SHINGLE))
            self.shingles.append(np.unique(s))
            # Shingles that begin in the question, and those that end in the answer.
            self.question.append(np.unique(s[:split]))
            self.answer.append(np.unique(s[max(split - SHINGLE + 1, 0) :]))
            self.parts.append((h, split))
        lengths = np.array([len(h) for _, _, h in kept], float)
        self.longest = int(lengths.max()) if len(kept) else 0
        item = np.repeat(np.arange(len(kept)), lengths.astype(int))
        flat = np.concatenate([h for _, _, h in kept] or [np.empty(0, np.uint64)])
        self.words, term = np.unique(flat, return_inverse=True)
        cell, tf = np.unique(item * max(len(self.words), 1) + term, return_counts=True)
        self.item, self.term = cell // max(len(self.words), 1), cell % max(len(self.words), 1)
        df = np.bincount(self.term, minlength=len(self.words))
        idf = np.log1p((len(kept) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean()) if len(kept) else lengths
        self.impact = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.item])
        self.ends = np.searchsorted(self.item, np.arange(len(kept) + 1))
        self.threshold, self.rest = np.zeros(len(kept)), np.zeros(len(kept))
        needed = np.zeros(len(self.item), bool)
        for k in range(len(kept)):
            rows = slice(self.ends[k], self.ends[k + 1])
            counts = np.sort(np.unique(_shingles(kept[k][2], min(len(kept[k][2]), SHINGLE)), return_counts=True)[1])[::-1]
            missing = int(counts[: int((1 - OVERLAP) * len(counts) + 1e-9)].sum())
            low = np.sort(self.impact[rows])
            self.threshold[k] = max(low[: max(len(low) - missing, 0)].sum() - 1e-9, 1e-9)
            order = np.argsort(self.impact[rows], kind="stable")
            skipped = np.cumsum(self.impact[rows][order]) < self.threshold[k]
            self.rest[k] = self.impact[rows][order][skipped].sum()
            needed[self.ends[k] + order[~skipped]] = True
        # Postings of the needed words, by term, then item; and the block maxima.
        order = np.flatnonzero(needed)[np.lexsort((self.item[needed], self.term[needed]))]
        self.p_item, self.p_impact = self.item[order], self.impact[order]
        self.p_at = np.searchsorted(self.term[order], np.arange(len(self.words) + 1))
        self.blocks = -(-len(kept) // BLOCK)
        cell, which = np.unique(self.term[order] * max(self.blocks, 1) + self.p_item // BLOCK, return_inverse=True)
        self.b_max = np.zeros(len(cell))
        np.maximum.at(self.b_max, which, self.p_impact)
        self.b_block = cell % max(self.blocks, 1)
        self.b_at = np.searchsorted(cell // max(self.blocks, 1), np.arange(len(self.words) + 1))
        self.slack = np.array([(self.rest - self.threshold)[b * BLOCK : (b + 1) * BLOCK].max() for b in range(self.blocks)])
        self.stride = max(32, self.longest)
        self.essential = np.diff(self.p_at) > 0
        self.small = np.zeros(1 << 16, bool)
        self.small[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _expand(self, at, values, keys, window, term):
        n = at[term + 1] - at[term]
        rows = np.repeat(at[term], n) + ragged(n)
        return np.repeat(window, n), keys[rows], values[rows]

    def candidates(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) that may reach the item's threshold. A window's number is 2**32 * text + its place."""
        some = np.flatnonzero(self.small[(h & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.words, h[some]), len(self.words) - 1)
        real = self.words[term] == h[some]
        some, term = some[real], term[real]
        text = np.searchsorted(first, some, "right") - 1
        place = (some - first[text]) // self.stride
        window = np.concatenate([(text << 32) + place, ((text << 32) + place - 1)[place > 0]])
        term = np.concatenate([term, term[place > 0]])
        names, window = np.unique(window, return_inverse=True)
        cell = window * len(self.words) + term
        present = np.zeros(_PRESENT, bool)
        present[_slot(cell)] = True
        cell = np.unique(cell[self.essential[term]])
        window, term = cell // len(self.words), cell % len(self.words)
        # Blocks of items whose bound may reach a threshold.
        w, block, most = self._expand(self.b_at, self.b_max, self.b_block, window, term)
        cell, which = np.unique(w * self.blocks + block, return_inverse=True)
        good = cell[np.bincount(which, most, len(cell)) + self.slack[cell % self.blocks] >= -1e-9] if len(cell) else cell
        if not len(good):
            return names[:0], names[:0]
        in_good = np.isin(window, np.unique(good // self.blocks))
        w, item, impact = self._expand(self.p_at, self.p_impact, self.p_item, window[in_good], term[in_good])
        also = np.isin(w * self.blocks + item // BLOCK, good)
        cell, which = np.unique(w[also] * len(self.ids) + item[also], return_inverse=True)
        bound = np.bincount(which, impact[also], len(cell)) + self.rest[cell % len(self.ids)]
        cell = cell[bound >= self.threshold[cell % len(self.ids)] - 1e-9]
        # The full scores of what is left; words are looked up by hash, so some may come out too high, none too low.
        window, item = cell // len(self.ids), cell % len(self.ids)
        n = self.ends[item + 1] - self.ends[item]
        rows = np.repeat(self.ends[item], n) + ragged(n)
        held = present[_slot(np.repeat(window, n) * len(self.words) + self.term[rows])]
        score = np.bincount(np.repeat(np.arange(len(cell)), n), self.impact[rows] * held, len(cell))
        cell = cell[score >= self.threshold[item] - 1e-9]
        return names[cell // len(self.ids)], cell % len(self.ids)

    def verify(self, h: np.ndarray, item: int) -> tuple[float, float, float, float] | None:
        """(score, overlaps with the item, its question, its answer) of a passage, or None below a threshold."""
        rows = slice(self.ends[item], self.ends[item + 1])
        score = float(self.impact[rows][np.isin(self.words[self.term[rows]], h)].sum())
        if score < self.threshold[item] - 1e-9:
            return None
        words_, split = self.parts[item]
        if len(words_) < SHINGLE:
            return (score, 1.0, 1.0, 1.0) if np.isin(self.shingles[item], _shingles(h, len(words_))).all() else None
        held = _shingles(h)
        share = [float(np.isin(s, held).mean()) for s in (self.shingles[item], self.question[item], self.answer[item])]
        if share[0] < OVERLAP - 1e-12:
            return None
        for k, part, a, b in ((1, self.question[item], 0, split), (2, self.answer[item], split, len(words_))):
            if len(part) < 2 * SHINGLE:
                share[k] = _in_place(words_, a, b, h, held)
        return (score, *share) if share[0] >= OVERLAP - 1e-12 and min(share[1:]) >= PART_OVERLAP else None


def _scan(shipped):
    def run(batches):
        index = shipped.value
        for pdf in batches:
            if not len(index.ids):
                continue
            for i, j, data, starts in slices(pdf["text"].tolist()):
                h, _, _, first = words(data, starts, alnum=True)
                if not len(h):
                    continue
                best: dict[tuple[int, int], tuple] = {}
                for window, item in zip(*(x.tolist() for x in index.candidates(h, first))):
                    text, a = window >> 32, (window & 0xFFFFFFFF) * index.stride
                    part = h[first[text] + a : min(first[text] + a + 2 * index.stride, first[text + 1])]
                    found = index.verify(part, item)
                    if found and (key := (text, item)) and (key not in best or found[1:2] + found[:1] > best[key][0][1:2] + best[key][0][:1]):
                        best[key] = (found, a, a + len(part))
                if best:
                    keys = sorted(best)
                    out = pd.DataFrame({"doc_id": pdf["doc_id"].array.take(np.array([i + t for t, _ in keys])), "item_id": [index.ids[k] for _, k in keys]})
                    for name, k in (("score", 0), ("overlap", 1), ("question_overlap", 2), ("answer_overlap", 3)):
                        out[name] = [best[key][0][k] for key in keys]
                    out["threshold"] = [index.threshold[k] for _, k in keys]
                    out["first_word"], out["last_word"] = [best[key][1] for key in keys], [best[key][2] for key in keys]
                    out["row_key"] = pdf["row_key"].array.take(np.array([i + t for t, _ in keys]))
                    yield out[[c.split()[0] for c in RESULT.split(", ")]]

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, key: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text) and item of benchmark(item_id, text) that it holds (and row_key)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row_key", row_key())
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null")
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, -(-count // SHARD), -(-chars // (SHARD * 500)))
    with scratch(spark):
        found = None
        for k in range(shards):
            rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).collect()
            shipped = spark.sparkContext.broadcast(Index([tuple(r) for r in rows]))
            part = keep(docs.mapInPandas(released(_scan(shipped)), RESULT), "leaks")
            shipped.unpersist()
            found = part if found is None else found.unionByName(part)
        found = lasting(found, "contaminated")
    return found if key else found.drop("row_key")
