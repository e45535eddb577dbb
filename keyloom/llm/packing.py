"""Packing documents into training windows by minimum bin slack.

Each document's ids (with the end id) are cut into full windows and a rest. The numbers of pieces of each length
are a histogram of at most `window` rows, whatever the input; the plan is made from it alone: as long as pieces
remain, take the longest, and let a bounded subset-sum over bit sets find the multiset of remaining lengths that
fills the window closest to its capacity; backtracking gives the counts of the multiset, which is used as often as
the histogram allows. Each multiset used up exhausts a length, so a plan has a few thousand rows at most.

Pieces are numbered within their length by counts for each partition and length, so neither a hot length nor a hot
source lands in one task; a piece's number gives its window and offset by a join with the plan, which is broadcast
(its size is bounded by the window).

Defined cases: a null text is empty and gives the end id alone; null and repeated doc_ids are packed like others;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import keep, released
from keyloom.llm.tokens import encoder, tokenizer_json

WINDOW = 2048


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to room. counts: how many there are of each length."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left:
            n = min(take, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left, take = left - n, take * 2
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            chosen[length] = chosen.get(length, 0) + n
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, dict[int, int]]]:
    """(first sequence, sequences, pieces of each length in one of them), until no piece remains."""
    counts, out, first = {k: n for k, n in counts.items() if n}, [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = fill({k: n for k, n in counts.items() if n}, window - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        out.append((first, times, chosen))
        first += times
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def _pieces(definition, window: int, end_id: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), encoder(definition.value).encode
        for pdf in batches:
            rows = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "number", "ids")}
            for a in range(0, len(pdf), 256):
                flat, at = encode(pdf["text"].iloc[a : a + 256].tolist())
                for k in range(len(at) - 1):
                    ids = np.append(flat[at[k] : at[k + 1]], flat.dtype.type(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        raw = ids[start : start + window].tobytes()
                        n = len(raw) // 4
                        for name, v in (("row", a + k), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(raw)), ("doc_tokens", len(ids)), ("number", seen[n]), ("ids", raw if with_ids else b"")):
                            rows[name].append(v)
                        seen[n] += 1
            out = pd.DataFrame(rows)
            out.insert(0, "doc_id", pdf["doc_id"].array.take(out.pop("row").to_numpy(dtype=np.int64)))
            out.insert(0, "part", part)
            yield out if with_ids else out.drop(columns="ids")

    return run


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (and ids), one row a piece.

    padded_length is the window, except for a sequence whose tokens are a power of two already.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer_json(tokenizer))
    schema = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long" + ", ids binary" * with_ids
    pieces = keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(released(_pieces(definition, window, end_id, with_ids)), schema), "pieces")
    cells = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    of_length = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    rows, used = [], dict.fromkeys(of_length, 0)
    for first, times, chosen in plan(of_length, window):
        offset, total = 0, sum(k * n for k, n in chosen.items())
        padded = total if total & (total - 1) == 0 else window
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * times, n, first, offset, padded))
            used[length] += n * times
            offset += length * n
    planned = spark.createDataFrame(rows, "p_length long, low long, high long, each long, first long, base long, padded_length long")
    before = cells.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("number") + F.col("before"))
    placed = ranked.join(F.broadcast(planned), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    k = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (k % F.col("each")) * F.col("length")).alias("offset"),
        "padded_length", *(["ids"] if with_ids else []),
    )
