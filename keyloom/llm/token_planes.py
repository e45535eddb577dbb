"""Token ids in plane-shuffled segments.

A dataset of segments holds the ids of all documents in ascending (doc_id, text) order. A segment holds whole
documents, a quarter million ids or so, and stands for itself:

    magic "KPL1", u32 block size, u32 bytes of an id, u64 ids, u32 documents, u32 blocks,
    document index (i64 doc_id, u64 first id in the segment, u64 ids) * documents,
    chunk index (u32 ids, u32 compressed bytes of each plane) * blocks, the planes.

Ids are cut into blocks of a fixed size; a block's ids are transposed into byte planes (all lowest bytes, then
the next) or bit planes (all lowest bits, then the next), and zstandard compresses each plane. Spark commits the
segments as binary cells of Parquet files, so lost tasks leave nothing behind, and any segment can be read alone.

Defined cases: a null text is empty and gives the end id alone; a null doc_id is stored as the smallest 64-bit
integer and comes first; rows with equal doc_id follow each other by text (null, then empty, first); an empty
table gives no segment; other columns are ignored. One document is held in memory at a time, whatever its length.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import lasting, new_path, released, shuffles, small_batches
from keyloom.llm.tokens import encoder, tokenizer_json

BLOCK_IDS = 1 << 15
SEGMENT_IDS = 1 << 18
#: Documents encoded at once.
BATCH = 256
_MAGIC, _HEAD, _NO_ID = b"KPL1", "<IIQII", -(1 << 63)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (or bit planes) of ids, lowest first."""
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if not bits:
        return [raw[:, k].tobytes() for k in range(raw.shape[1])]
    cells = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(cells[:, k], bitorder="little").tobytes() for k in range(cells.shape[1])]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype, bits: bool) -> np.ndarray:
    if not bits:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)).view(dtype).reshape(n)
    cells = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
    return np.packbits(cells, axis=1, bitorder="little").view(dtype).reshape(n)


def write_segment(doc_ids: list[int], sizes: list[int], ids: np.ndarray, bits: bool = False, block: int = BLOCK_IDS, level: int = 3) -> bytes:
    import zstandard

    packer = zstandard.ZstdCompressor(level=level)
    index, body = [], []
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        planes = [packer.compress(p) for p in to_planes(part, bits)]
        index.append(struct.pack(f"<{1 + len(planes)}I", len(part), *map(len, planes)))
        body += planes
    first = np.cumsum([0, *sizes])[: len(sizes)]
    docs = b"".join(struct.pack("<qQQ", d, f, n) for d, f, n in zip(doc_ids, first.tolist(), sizes))
    return b"".join([_MAGIC, struct.pack(_HEAD, block | (1 << 31) * bits, ids.dtype.itemsize, len(ids), len(doc_ids), len(index)), docs, *index, *body])


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, first ids, sizes, ids); raises if anything is missing or left over."""
    import zstandard

    if raw[:4] != _MAGIC:
        raise ValueError("not a segment")
    block, width, n, documents, blocks = struct.unpack_from(_HEAD, raw, 4)
    bits, dtype = bool(block >> 31), np.dtype(f"<u{width}")
    at = 4 + struct.calcsize(_HEAD)
    docs = np.frombuffer(raw, np.dtype([("id", "<i8"), ("first", "<u8"), ("n", "<u8")]), documents, at)
    at += docs.nbytes
    planes = width * (8 if bits else 1)
    index = np.frombuffer(raw, "<u4", blocks * (1 + planes), at).reshape(blocks, 1 + planes)
    at += index.nbytes
    unpack, out = zstandard.ZstdDecompressor(), []
    for count, *lengths in index.tolist():
        cells = []
        for length in lengths:
            cells.append(unpack.decompress(raw[at : at + length]))
            at += length
        out.append(from_planes(cells, count, dtype, bits))
    ids = np.concatenate([*out, np.empty(0, dtype)])
    if at != len(raw) or len(ids) != n or docs["n"].sum() != n:
        raise ValueError("a damaged segment")
    return docs["id"], docs["first"].astype(np.int64), docs["n"].astype(np.int64), ids


def _segments(definition, end_id: int, bits: bool, segment: int, block: int):
    """Encodes a sorted partition's documents and gives its segments."""

    def run(batches):
        from pyspark import TaskContext

        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids_of, doc_ids, sizes, held, encode = [], [], [], 0, encoder(definition.value).encode

        def flush():
            nonlocal number, start, held
            raw = write_segment(doc_ids, sizes, np.concatenate(ids_of), bits, block)
            row = pd.DataFrame({"part": [part], "segment": [number], "start_in_part": [start], "n_ids": [held], "first_doc_id": [doc_ids[0]], "payload": [raw]})
            number, start, held = number + 1, start + held, 0
            for x in (ids_of, doc_ids, sizes):
                x.clear()
            return row

        for pdf in batches:
            for a in range(0, len(pdf), BATCH):
                docs = [_NO_ID if pd.isna(d) else int(d) for d in pdf["doc_id"].iloc[a : a + BATCH]]
                flat, at = encode(pdf["text"].iloc[a : a + BATCH].tolist())
                for k, doc in enumerate(docs):
                    ids_of += [flat[at[k] : at[k + 1]], np.array([end_id], flat.dtype)]
                    doc_ids.append(doc)
                    sizes.append(int(at[k + 1] - at[k]) + 1)
                    held += sizes[-1]
                    if held >= segment:
                        yield flush()
        if doc_ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, bits: bool = False, segment_ids: int = SEGMENT_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of docs(doc_id, text) in ascending doc_id order as segments under path."""
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer_json(tokenizer))
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(shuffles(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    run = _segments(definition, end_id, bits, segment_ids, block_ids)
    found = ordered.mapInPandas(released(run), "part int, segment int, start_in_part long, n_ids long, first_doc_id long, payload binary")
    with small_batches(spark):
        found.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian unsigned 32-bit, as binary) from the segments.

    Each partition's ids before it come from a sum over the partitions' totals, one row for each file written.
    """
    segments = spark.read.schema("part int, segment int, start_in_part long, n_ids long, first_doc_id long, payload binary").parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches):
        for pdf in batches:
            for part, start, raw in zip(pdf["part"], pdf["start_in_part"], pdf["payload"]):
                docs, first, sizes, ids = read_segment(raw)
                wide = ids.astype("<u4")
                cells = [wide[f : f + n].tobytes() for f, n in zip(first.tolist(), sizes.tolist())]
                out = pd.DataFrame({"part": part, "doc_id": pd.array(docs, "Int64"), "at": first + start, "n_tokens": sizes, "ids_crc32": [zlib.crc32(c) for c in cells]})
                out.loc[docs == _NO_ID, "doc_id"] = pd.NA
                yield out.assign(ids=cells) if with_ids else out

    found = segments.select("part", "start_in_part", "payload").mapInPandas(released(run), "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    found = lasting(found, "token-index") if not with_ids else found
    return found.join(before, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_planes(docs: DataFrame, **options) -> DataFrame:
    """write_tokens() to the shared folder, then read_tokens()."""
    path = new_path(docs.sparkSession, "token-planes")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
