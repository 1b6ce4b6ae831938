"""A content-addressed WARC archive: payloads once by digest, exact record headers apart, records rebuilt by joins.

An archive folder holds two tables. ``payloads`` has every distinct payload once, under its SHA-256, compressed by itself
as records of compressed archives are. ``records`` has one row per record with its complete header. A record is its
header followed by the payload that its digest names; reading decompresses the payload and checks length and digest.

Digests travel first and alone; payloads are combined within each task before the one shuffle that makes them unique.
A payload that very many records share is read by as many tasks as its records need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import salted_join
from tidemark.workspace import Workspace

#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
#: Records that one copy of a shared payload serves when records are rebuilt.
SHARED = 1_000

# The format's names.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def _payload(html) -> bytes:
    return (html.as_py() or "").encode("utf-8", "surrogatepass")


def _digests(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``digest``, ``n_bytes`` of each page's payload."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, digest string, n_bytes bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(hashlib.sha256(p).hexdigest(), len(p)) for p in map(_payload, batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([d for d, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                names=["page_id", "url", "digest", "n_bytes"],
            )

    return rows.mapInArrow(run, schema)


def _compressed(pages: DataFrame) -> DataFrame:
    """``digest`` and the compressed ``payload`` of each page; of equal ones in a batch only one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            unique: dict[str, list] = {}
            for payload in map(_payload, batch.column("html")):
                known = unique.setdefault(hashlib.sha256(payload).hexdigest(), [payload, 0])
                known[1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(unique), pa.string()), pa.array([packer.compress(p) for p, _ in unique.values()], pa.binary()), pa.array([n for _, n in unique.values()], pa.int64())],
                names=["digest", "payload", "n"],
            )

    return pages.select(F.col("html").cast("string").alias("html")).mapInArrow(run, "digest string, payload binary, n bigint")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def header(revisit: Column) -> Column:
    """The whole header, up to and with its empty line, from page_id, url, digest, n_bytes and ``first`` (a page_id)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    return F.concat(
        F.lit(VERSION + END),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        # A line end within an address would end the line.
        line("WARC-Target-URI", F.translate(F.coalesce("url", F.lit("")), "\r\n", "")),
        line("WARC-Date", F.lit(DATE)),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0).cast("bigint")).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(END),
    )


def write_archive(pages: DataFrame, folder: str, space: Workspace) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to ``folder``.

    The payload is the html in UTF-8, empty for null. Of the records with one payload of at least ``REVISIT_BYTES`` the
    one with the smallest page_id is a response and the others are revisits that refer to it; shorter payloads are
    responses all. A null page_id comes after all others; records without any id among equal payloads are all
    responses. Repeated rows are records each. An empty table makes an empty archive. Other columns are not looked at.
    """
    digests = space.keep(_digests(pages), "digests")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    known = salted_join(digests, firsts, ["digest"], ["page_id", "url"])
    revisit = (F.col("n_bytes") >= REVISIT_BYTES) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = known.select("digest", header(revisit).alias("header"), "copies")
    records.write.mode("errorifexists").parquet(f"{folder}/records")
    unique = _compressed(pages).groupBy("digest").agg(F.first("payload").alias("payload"), F.sum("n").alias("copies"))
    # Compressed already.
    unique.write.mode("errorifexists").option("compression", "none").parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``header`` and ``payload`` (full, also of revisits) of every record; a damaged payload ends the read with an error."""
    records = spark.read.parquet(f"{folder}/records")
    payloads = spark.read.parquet(f"{folder}/payloads")
    parts = F.expr(f"cast(copies div {SHARED} as int) + 1")
    dealt = records.select("digest", "header", F.pmod(F.xxhash64("header"), parts).cast("int").alias("part"))
    copies = payloads.select("digest", "payload", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    joined = dealt.join(copies, ["digest", "part"], "left").select("digest", "header", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            found = []
            for digest, packed in zip(batch.column("digest").to_pylist(), batch.column("payload")):
                packed = packed.as_py()
                payload = b"" if packed is None else opener.decompressobj().decompress(packed)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the archive has no sound payload for {digest}")
                found.append(payload)
            yield pa.RecordBatch.from_arrays([batch.column("header"), pa.array(found, pa.binary())], names=["header", "payload"])

    return joined.mapInArrow(run, "header string, payload binary")


def field(name: str) -> Column:
    """A field of ``header``; null where it is missing."""
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def record_bytes() -> Column:
    """The original record: header, the payload of a response, and the two line ends after it."""
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n"))
