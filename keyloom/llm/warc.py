"""WARC archives with revisit records.

Payloads are digested; headers alone (digest, page_id, length) are shuffled by digest, and the smallest page_id of
each digest of at least 100 bytes becomes the response that later records revisit. Archives are written with fresh
headers by Spark's text writer, whose line separator (two CRLFs) is what ends a WARC record: so files are plain
WARC/1.1, gzipped, and committed by Spark. Pages are written by classes of size, larger ones in files of fewer records, so
that a file has FILE_BYTES of payload at most, or one record. A page's decision meets its payload by page_id; pages that
a bitmap of bounded size shows to be no revisits stay where they are, unshuffled. Reading takes the files as binary,
unpacks them piece by piece and cuts them by Content-Length, so that a worker holds one file packed and one record
unpacked; revisit records are resolved by joining them with the responses on the digest, so that each page has its full
payload's length and digest again.

A payload is a page's text in UTF-8, null counting as empty. Defined cases: a null page_id is written without
record number and comes back null; it is a response, and others revisit it only if no page with an id has its
payload; repeated rows with the same page_id are separate
records, all of them responses where it is their payload's smallest; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import SIEVE_BITS, keep, lasting, new_path, scratch, sieve

LEAST_BYTES, RECORDS, FILE_BYTES = 100, 4000, 64 << 20
_CRLF = "\r\n"


def resolve(pages: DataFrame) -> DataFrame:
    """page_id, digest, bytes, refers_to: headers only. Of equal rows, one may be the response."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))


def write_archives(pages: DataFrame, path: str, records: int = RECORDS) -> None:
    """One record per row of pages(page_id, url, html) under path."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    head = resolve(rows).filter(F.col("bytes") >= LEAST_BYTES)
    first = head.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("copies")).filter("copies > 1 and original is not null")
    with scratch(pages.sparkSession):
        later = keep(head.filter("page_id is not null").join(first, "digest").filter("page_id != original").select("page_id", F.col("digest").alias("of"), "original").distinct(), "revisits")
        # Classes of size, fourfold each; how many there are is known from header rows.
        small = max(FILE_BYTES // records, 1)
        size = F.octet_length("html")
        kind = sum(F.when(size > small * 4**k, 1).otherwise(0) for k in range(12))
        kinds = sorted(r[0] for r in rows.select(kind.alias("kind")).distinct().collect())
        for k in kinds:
            part = rows if len(kinds) == 1 else rows.filter(kind == k)
            _records(part, later).write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, records // 4**k)).mode("append").text(path)
        if not kinds:
            _records(rows, later).write.option("compression", "gzip").text(path)


def _records(rows: DataFrame, later: DataFrame) -> DataFrame:
    """The records of rows; later: pages that revisit."""
    digest, length = F.sha2(F.col("html").cast("binary"), 256), F.octet_length("html")
    rows = rows.withColumn("k", F.pmod(F.xxhash64("page_id"), F.lit(SIEVE_BITS)))
    rows = rows.join(F.broadcast(sieve(later.select("page_id"))), F.shiftright("k", 6) == F.col("sieve_cell"), "left")
    rows = rows.withColumn("hit", F.coalesce(F.expr("(shiftright(sieve_bits, cast(k % 64 as int)) & 1) = 1"), F.lit(False))).drop("k", "sieve_cell", "sieve_bits")
    later = later.select(F.col("page_id").alias("later_id"), "of", "original")
    hit = rows.filter("hit").withColumn("digest", digest).join(later, (F.col("page_id") == F.col("later_id")) & (F.col("digest") == F.col("of")), "left").drop("later_id", "of")
    found = rows.filter("not hit").withColumn("digest", digest).withColumn("original", F.lit(None).cast("long")).unionByName(hit)
    revisit = F.col("original").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    record = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    number = F.xxhash64("page_id", "url", F.monotonically_increasing_id())
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(record(F.col("page_id")), F.concat(F.lit("<urn:record:"), F.hex(number), F.lit(">")))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record(F.col("original")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(length).cast("string")),
    ]
    value = F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    return found.select(value.alias("value"))


def records_of(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an uncompressed archive, read record by record; raises where it isn't whole."""
    while version := archive.readline():
        headers = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().removesuffix(_CRLF).partition(":")
            headers[name] = value.removeprefix(" ")
        payload = archive.read(int(headers["Content-Length"]))
        if version != b"WARC/1.1\r\n" or archive.read(4) != b"\r\n\r\n":
            raise ValueError("a damaged archive")
        yield headers, payload


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload, of responses) of every record."""

    def run(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                rows = []
                for h, payload in records_of(gzip.GzipFile(fileobj=io.BytesIO(raw))):
                    ids = [int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", h.get(k, ""))) else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    new = h["WARC-Type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if new else h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if new and digest != h["WARC-Payload-Digest"].removeprefix("sha256:"):
                        raise ValueError("a payload differs from its digest")
                    rows.append((ids[0], len(payload) if new else None, digest, h["WARC-Type"], ids[1], payload if with_payload else b""))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                out = out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
                yield out if with_payload else out.drop(columns="payload")

    files = spark.read.format("binaryFile").load(path).filter(F.col("path").endswith(".gz")).select("content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    found = lasting(files.mapInPandas(run, schema), "records")
    new, later = found.filter("record_type = 'response'"), found.filter("record_type = 'revisit'").drop("payload_bytes")
    original = new.filter("page_id is not null").groupBy("payload_digest", F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"))
    return new.unionByName(later.join(original, ["payload_digest", "refers_to"]).select(*found.columns))


def archive(pages: DataFrame) -> DataFrame:
    """write_archives() to the shared folder, then read_archives()."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
