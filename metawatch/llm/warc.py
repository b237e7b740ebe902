"""A content-addressed archive of web records.

``records`` writes pages as archive records: a header block, an empty line and the payload.
``archive`` takes records apart into a table of the exact headers, one per record, and a table
of the payloads, one per SHA-256 digest however many records share it.  Payloads are kept
compressed.  ``restore`` joins the two and gives back the original bytes; each payload's digest
and length are verified first, and a payload that does not match stops the job.

Defined results: a null html or url counts as empty; records without an empty line are all header,
with an empty payload; repeated rows give repeated records, over one payload; empty tables give
empty tables; further columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, written

_BREAK = b"\r\n\r\n"


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record): each page as a resource record in bytes."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select("page_id", F.concat(head, html).cast("binary").alias("record"))


def archive(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers: page_id, header, digest; payloads: digest, size, payload), both written to the shared folder.

    Records that share a digest are compared by size and a second, unlike hash before one payload is kept.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [(x or b"").partition(_BREAK) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h + cut for h, cut, _ in split], pa.binary()), pa.array([hashlib.sha256(x).digest() for *_, x in split], pa.binary())],
                ["page_id", "header", "digest"],
            )

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            body = [(x or b"").partition(_BREAK)[2] for x in b.column(0).to_pylist()]
            second = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in body]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(x).digest() for x in body], pa.binary()), pa.array([len(x) for x in body], pa.int64()), pa.array([squeeze(x) for x in body], pa.binary()), pa.array(second, pa.int64())],
                ["digest", "size", "payload", "second"],
            )

    bounded_batches(recs.sparkSession)
    page_id = recs.schema["page_id"].dataType.simpleString()
    headers = recs.select("page_id", "record").mapInArrow(heads, f"page_id {page_id}, header binary, digest binary")
    same = (F.max("second") == F.min("second")) & (F.max("size") == F.min("size"))
    stored = (
        recs.select("record").mapInArrow(bodies, "digest binary, size long, payload binary, second long")
        .groupBy("digest")
        .agg(F.when(same, F.first("size")).otherwise(F.raise_error(F.lit("two payloads share a digest"))).alias("size"), F.first("payload").alias("payload"))
    )
    return written(headers, "warc-headers"), written(stored, "warc-payloads")


def restore(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, digest as hex, size, record): the original records, verified."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            whole = []
            for head, digest, size, body in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                body = expand(body, max_output_size=size) if size else b""
                if len(body) != size or hashlib.sha256(body).digest() != digest:
                    raise ValueError(f"payload {digest.hex()} is damaged")
                whole.append(head + body)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.hex() for x in b.column(2).to_pylist()], pa.string()), b.column(3), pa.array(whole, pa.binary())], ["page_id", "digest", "size", "record"])

    kind = f"page_id {headers.schema['page_id'].dataType.simpleString()}, digest string, size long, record binary"
    return headers.join(payloads, "digest").select("page_id", "header", "digest", "size", "payload").mapInArrow(part, kind)
