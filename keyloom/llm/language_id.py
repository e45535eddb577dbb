"""Hierarchical language identification.

Texts become counts of hashed byte bigrams and trigrams over letters (A-Z lower-cased, every other ASCII character a
blank), as 1 + log, at unit length. From a bounded sample of labelled documents, languages are grouped into families
by the likeness of their mean vectors; one linear support vector machine a family tells families apart, and inside a
family one-versus-one machines tell its languages apart, by votes and then margins. The score is the softmax share of
the chosen family times the least of the chosen language's pairwise logistic margins.

Learned only from text and lang of the rows given for training: PER_LANGUAGE rows or so of each language, drawn by a
hash of doc_id, or an equal number fewer of each where there are more than TOTAL / PER_LANGUAGE languages; every
language is learned. Prediction reads text alone.

Defined cases: a text that is null or has no letter is `und` with score 0; so is any text if nothing could be learned;
with one learned language, texts with a letter get it with score 1; rows are judged one by one, so repeats agree;
languages that are null in training are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bytetext import _LOWER, slices
from keyloom.llm.common import keep, lasting, released, row_key, scratch

BUCKETS = 2048
PER_LANGUAGE, TOTAL = 800, 8000

_LETTERS = _LOWER.copy()
_LETTERS[:128] = [c if 97 <= c <= 122 else 32 for c in _LOWER[:128]]


def features(texts: list[str | None]):
    """Yields (first text, rows of unit length) for slices of texts."""
    for i, j, data, starts in slices(texts):
        b = _LETTERS[data].astype(np.uint32)
        cell = (np.searchsorted(starts, np.arange(0, len(b)), "right") - 1) * BUCKETS if j - i < 2 else np.repeat(np.arange(j - i) * BUCKETS, np.diff(starts))
        two = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (b[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        rows = np.bincount(cell[:-1] + (two >> np.uint32(21)), minlength=(j - i) * BUCKETS) + np.bincount(cell[:-2] + (three >> np.uint32(21)), minlength=(j - i) * BUCKETS)
        rows = np.log1p(rows.reshape(j - i, BUCKETS).astype(np.float32))
        yield i, rows / np.maximum(np.sqrt((rows**2).sum(1, keepdims=True)), 1e-9)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, strength: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Weights (with the bias last) of a linear support vector machine for y in -1, 1, by averaged subgradient steps."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 32):
            rows = order[a : a + 32]
            t += 1
            rate = 1 / (strength * (t + 1000))
            bad = y[rows] * (x[rows] @ w) < 1
            w = (1 - rate * strength) * w + rate / len(rows) * ((weight[rows] * y[rows] * bad) @ x[rows])
            w *= min(1.0, 1 / np.sqrt(strength) / max(np.linalg.norm(w), 1e-12))
            if epoch >= epochs // 2:
                mean += w
    return mean / max(1, t - (epochs // 2) * -(-len(x) // 32))


def families(means: np.ndarray) -> list[list[int]]:
    """Languages joined while their groups' mean vectors are more alike than languages are on the whole."""
    groups = [[k] for k in range(len(means))]
    alike = means @ means.T / np.maximum(np.outer(n := np.linalg.norm(means, axis=1), n), 1e-9)
    if len(groups) < 3:
        return groups
    level = alike[np.triu_indices(len(means), 1)].mean()
    while len(groups) > 1:
        pairs = [(alike[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        best, i, j = max(pairs)
        if best <= level:
            break
        groups[i] += groups.pop(j)
    return [sorted(g) for g in groups]


def learn(x: np.ndarray, lang: list[str]) -> dict:
    names = sorted(set(lang))
    y = np.array([names.index(v) for v in lang])
    groups = families(np.array([x[y == k].mean(0) for k in range(len(names))])) if names else []
    family_of = np.zeros(len(names), int)
    for g, members in enumerate(groups):
        family_of[members] = g
    outer = [svm(x, np.where(family_of[y] == g, 1.0, -1.0)) for g in range(len(groups))] if len(groups) > 1 else []
    inner = []
    for members in groups:
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                rows = (y == a) | (y == b)
                inner.append((a, b, svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))))
    return {"names": names, "groups": groups, "outer": np.array(outer, np.float32), "inner": inner}


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score) of each row."""
    x1 = np.column_stack([x, np.ones(len(x), x.dtype)])
    family, share = np.zeros(len(x), int), np.ones(len(x))
    if len(model["outer"]):
        margins = 2 * (x1 @ model["outer"].T)
        family = margins.argmax(1)
        share = 1 / np.exp(margins - margins.max(1, keepdims=True)).sum(1)
    lang = np.array([g[0] for g in model["groups"]])[family]
    pairs = {(a, b): x1 @ w.astype(np.float32) for a, b, w in model["inner"]}
    for g, members in enumerate(model["groups"]):
        rows = family == g
        if len(members) > 1 and rows.any():
            m = np.stack([np.stack([pairs[a, b][rows] if (a, b) in pairs else -pairs[b, a][rows] if a != b else np.full(rows.sum(), np.inf) for b in members], 1) for a in members], 1)
            votes = (m > 0).sum(2) + 1e-3 * np.tanh(np.where(np.isinf(m), 0, m).sum(2))
            best = votes.argmax(1)
            lang[rows] = np.array(members)[best]
            share[rows] *= 1 / (1 + np.exp(-2 * np.clip(m[np.arange(len(best)), best].min(1), -20, 20)))
    return lang, np.clip(share, 0, 1)


def train(docs: DataFrame, training) -> dict:
    """A model from the rows of docs(doc_id, text, lang) that training selects."""
    rows = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    with scratch(docs.sparkSession):
        counts = keep(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
        each = max(1, min(PER_LANGUAGE, TOTAL // max(1, counts.count())))
        draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) * F.col("n") < F.lit(each * 1_000_000)

        def run(batches):
            for pdf in batches:
                texts = [t if has_letter(t) else None for t in pdf["text"]]
                for i, x in features(texts):
                    some = [k for k in range(len(x)) if texts[i + k] is not None]
                    yield pd.DataFrame({"lang": [pdf["lang"].iat[i + k] for k in some], "x": [x[k].tobytes() for k in some]})

        found = keep(rows.join(counts, "lang").filter(draw).mapInPandas(released(run), "lang string, x binary"), "language-sample").toPandas().sort_values(["lang", "x"])
    return learn(np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, BUCKETS), found["lang"].tolist())


def identify(docs: DataFrame, model: dict, key: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and row_key, of doc_id and text), one row for each row of docs(doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shipped.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [], []
            for i, x in features(texts):
                lang, score = predict(m, x) if m["names"] else (np.zeros(len(x), int), np.zeros(len(x)))
                fine = np.array([has_letter(t) for t in texts[i : i + len(x)]]) & bool(m["names"])
                langs += [m["names"][k] if ok else "und" for k, ok in zip(lang, fine)]
                scores.append(np.where(fine, score, 0.0).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.empty(0)])), batch.column(2)], names=["doc_id", "lang_pred", "score", "row_key"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row_key", row_key())
    found = lasting(rows.mapInArrow(released(run), "doc_id long, lang_pred string, score double, row_key long"), "languages")
    return found if key else found.drop("row_key")
