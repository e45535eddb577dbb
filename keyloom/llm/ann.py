"""Nearest neighbours by collision-counting hashing.

A block of vectors is split by length into ranges (norm ranging). Within a range, vectors get one more component that
brings them to the range's largest length, and a query is scaled to that length (with 0 there), so that nearness is that
of inner products. A range is indexed by PROJECTIONS single projections: for each, its values in sorted order. A query
opens windows centred on its own projections, from a width somewhat below that which the query before it needed; by virtual
rehashing they widen by a constant factor, and what newly falls into a window counts one collision more. Vectors in the windows of THRESHOLD of the projections are verified: by their exact inner
product on the original vectors. A range is done when the k-th best distance so far is no more than the windows' half
width: a vector at that distance falls into a window with a probability of 0.68 and passes the threshold with one of 0.85,
nearer ones and those of wider windows with more. That holds for any data; what the index can skip depends on them: of
vectors in uniformly random directions, whose nearest are hardly nearer than the rest, a third, of clustered ones nearly
all (figures in the README).

Ranges come by descending length, and one whose largest length times the query's doesn't reach the k-th best inner product
is skipped, as it holds nothing better. Ranges of fewer than SMALL vectors are verified whole. With exact=True
so is every range that isn't skipped.

Every row is indexed. Queries and vectors are dealt into blocks of bounded size by hashes of their ids, and each
block of queries meets each block of vectors once; a query's best of each block are merged by a window on the query.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
of null vec_id; rows that repeat a vec_id count as one vector, the smallest in array order; only vectors of equally
many components meet; with fewer than `k` candidates all are returned; ties go to the smaller vec_id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD, WIDEN = 64, 0.62, 1.25
#: Lengths of a range, least to largest; vectors below which a range has no index.
RANGE, SMALL = 0.85, 128
BLOCK, QUERIES = 8192, 2048


class Range:
    """Sorted projections of vectors (rows of a block) of about one length."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, lengths: np.ndarray, axes: np.ndarray):
        self.rows, self.top = rows, float(lengths[rows].max())
        self.axes, self.start, self.ends = axes, 0, {}
        if len(rows) >= SMALL:
            fill = np.sqrt(np.maximum(self.top**2 - lengths[rows] ** 2, 0))
            cast = np.column_stack([vectors[rows], fill]) @ axes
            order = np.argsort(cast, axis=0, kind="stable")
            self.ids = np.ascontiguousarray(order.T)
            self.values = np.ascontiguousarray(np.take_along_axis(cast, order, 0).T)
            self.width = max(float((self.values[:, 3 * len(rows) // 4] - self.values[:, len(rows) // 4]).mean()) / 24, 1e-12 * self.top)

    def ask(self, queries: np.ndarray, lengths: np.ndarray) -> None:
        """The queries that come now, scaled to the range's length and projected."""
        self.at, self.ends = (queries * (self.top / lengths)[:, None]) @ self.axes[:-1], {}

    def windows(self, k: int, level: int) -> tuple[list[int], list[int]]:
        """The ends of query k's windows, in every projection; looked up for all queries at once."""
        if level not in self.ends:
            width = self.width * WIDEN**level
            lo = np.stack([np.searchsorted(v, x - width) for v, x in zip(self.values, self.at.T)], 1)
            hi = np.stack([np.searchsorted(v, x + width, "right") for v, x in zip(self.values, self.at.T)], 1)
            self.ends[level] = lo, hi
        lo, hi = self.ends[level]
        return lo[k].tolist(), hi[k].tolist()


class Index:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, seed: int = 7):
        self.vectors, self.names = vectors, ids
        self.columns, self.rough = np.ascontiguousarray(vectors.T), vectors.astype(np.float32)
        self.lengths = np.sqrt((vectors**2).sum(1))
        axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        order = np.argsort(-self.lengths, kind="stable")
        self.ranges, a = [], 0
        while a < len(order):
            b = a + int(np.searchsorted(-self.lengths[order[a:]], -RANGE * self.lengths[order[a]], "right"))
            self.ranges.append(Range(vectors, order[a:b], self.lengths, axes))
            a = b

    def nearest(self, queries: np.ndarray, k: int, but: np.ndarray | None = None, exact: bool = False):
        """Yields (rows, scores, vectors verified) of the k largest inner products found, ties to smaller ids, of each query;
        but: an id to leave out for each."""
        lengths = np.sqrt((queries**2).sum(1))
        for part in self.ranges:
            if not exact and len(part.rows) >= SMALL:
                part.ask(queries, lengths)
        for i, (query, length) in enumerate(zip(queries, lengths.tolist())):
            yield self._nearest(i, query, length, k, None if but is None else but[i], exact)

    def _nearest(self, i: int, query: np.ndarray, length: float, k: int, but, exact: bool):
        best, score, verified, short = np.empty(0, np.int64), np.empty(0), 0, query.astype(np.float32)

        def merge(rows):
            nonlocal best, score, verified
            rows = rows[self.names[rows] != but] if but is not None else rows
            verified += len(rows)
            rough = self.rough[rows] @ short
            # Rounding to single precision stays below this; what may be among the best is summed exactly, by component.
            slack = 1e-5 * length * self.lengths[rows].max(initial=0.0)
            low = score[-1] if len(best) == k else np.partition(rough, len(rough) - k)[len(rough) - k] if len(rows) > k else -np.inf
            rows = rows[rough >= low - slack]
            total = np.zeros(len(rows))
            for column, x in zip(self.columns, query):
                total += column[rows] * x
            best, score = np.append(best, rows), np.append(score, total)
            top = np.lexsort((self.names[best], -score))[:k]
            best, score = best[top], score[top]

        for part in self.ranges:
            if len(best) == k and length * part.top < score[-1] * (1 - 1e-12) - 1e-300:
                break
            if exact or len(part.rows) < SMALL:
                merge(part.rows)
                continue
            least, n, level = int(np.ceil(THRESHOLD * PROJECTIONS)), len(part.rows), part.start
            hits, new = np.zeros(n, np.int64), np.ones(n, bool)
            lo, hi = part.windows(i, level)
            fresh = [ids[a:b] for ids, a, b in zip(part.ids, lo, hi)]
            while True:
                hits += np.bincount(np.concatenate(fresh), minlength=n)
                found = np.flatnonzero(new & (hits >= least))
                if len(found):
                    new[found] = False
                    merge(part.rows[found])
                if not new.any():
                    break
                if len(best) == k:
                    # Distance of the k-th best in the range's space, where the query has the range's length.
                    apart = np.sqrt(max(2 * part.top**2 - 2 * part.top / length * score[-1], 0.0))
                    if apart <= part.width * WIDEN**level:
                        break
                level += 1
                left, right = lo, hi
                lo, hi = part.windows(i, level)
                fresh = [ids[a:b] for ids, a, b in zip(part.ids, lo, left)] + [ids[a:b] for ids, a, b in zip(part.ids, right, hi)]
            # The next query's windows begin a little narrower than this one's ended.
            part.start = max(level - 2, 0)
        return best, score, verified


def _search(k: int, exact: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        mine, asked = block[~block["is_query"]], block[block["is_query"]]
        out = {"query_id": [], "vec_id": [], "score": [], "verified": []}
        if len(mine) and len(asked):
            index = Index(np.array(mine["embedding"].tolist(), np.float64), mine["vec_id"].to_numpy())
            names, queries = asked["vec_id"].to_numpy(), np.array(asked["embedding"].tolist(), np.float64)
            for a in range(0, len(names), 256):
                for name, (rows, score, verified) in zip(names[a : a + 256].tolist(), index.nearest(queries[a : a + 256], k, names[a : a + 256], exact)):
                    out["query_id"] += [name] * len(rows)
                    out["vec_id"] += index.names[rows].tolist()
                    out["score"] += score.tolist()
                    out["verified"] += [verified] * len(rows)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "verified": "int64"})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row of vectors(vec_id, embedding) that is_query selects."""
    fine = F.size("embedding") > 0
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    vectors = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    n, queries = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = -(-n // BLOCK) or 1, -(-queries // QUERIES) or 1
    deal = lambda parts, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = vectors.select("dim", "vec_id", "embedding", F.lit(False).alias("is_query"), deal(blocks, 1).alias("block"), every(query_blocks).alias("query_block"))
    asked = vectors.filter(is_query).select("dim", "vec_id", "embedding", F.lit(True).alias("is_query"), every(blocks).alias("block"), deal(query_blocks, 2).alias("query_block"))
    found = held.unionByName(asked).groupBy("dim", "block", "query_block").applyInPandas(_search(k, exact), "query_id long, vec_id long, score double, verified long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
