"""Content-addressed archive of web records.

An archive is a folder of two tables. ``payloads`` holds each distinct payload once, as one gzip member, under the
SHA-256 of its bytes. ``records`` holds the exact header block of each record with the digest that its payload has.
Reading joins the two, verifies every payload against its digest and gives the records back byte for byte.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest page id is a response and the
others are revisits that name it; payloads below that size make responses only. Defined cases: a null html is the
empty payload; rows that repeat the smallest id of a payload are all responses; a null id never is the smallest, so
such a row is a revisit where the payload has another id, and a response otherwise; control characters in a URL are
stored as %20, a null URL as an empty one; further columns of the input are ignored; an empty table makes an empty
archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.llm.common import arrow, scratch, slices

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, member): each payload that the task has not packed before, as a gzip member."""
    seen: set[str] = set()
    for b in slices(batches, "payload"):
        digests, packed = [], []
        for d, p in zip(b.column("digest").to_pylist(), b.column("payload")):
            if d not in seen:
                seen.add(d)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                digests.append(d)
                packed.append(z.compress(p.as_buffer()) + z.flush())
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(packed, pa.binary())], ["digest", "member"])


def _header(least: int) -> Column:
    """The header block of a record, up to and with the empty line."""
    revisit = (F.col("payload_bytes") >= least) & F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1f\x7f]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("head").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write pages (page_id, url, html) as an archive. Payloads are shuffled once, packed; headers are small rows."""
    raw = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    raw = raw.withColumn("digest", F.sha2("payload", 256))
    arrow(_pack, raw.select("digest", "payload"), "digest string, member binary").groupBy("digest").agg(F.first("member").alias("member")).write.option("compression", "uncompressed").parquet(f"{path}/payloads")
    rows = raw.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    heads = rows.groupBy("digest").agg(F.min("page_id").alias("head"))
    rows.join(heads, "digest").select("page_id", "digest", _header(least).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def _unpack(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "member", 1 << 22):
        sizes, digests, records = [], [], []
        for digest, member, header in zip(b.column("digest").to_pylist(), b.column("member").to_pylist(), b.column("header").to_pylist()):
            if member is None:
                raise ValueError(f"no payload is stored under {digest}")
            payload = zlib.decompress(member, 31)
            found = hashlib.sha256(payload).hexdigest()
            if found != digest:
                raise ValueError(f"the payload stored under {digest} has the digest {found}")
            sizes.append(len(payload))
            digests.append(found)
            if whole:
                records.append(header.encode() + payload + b"\r\n\r\n")
        out = [b.column("page_id"), b.column("header"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
        names = ["page_id", "header", "payload_bytes", "payload_digest"]
        yield pa.RecordBatch.from_arrays(out + [pa.array(records, pa.binary())] * whole, names + ["record"] * whole)


def read_archive(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The records of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to and url.

    whole adds ``record``: header, payload (of a revisit, that which it refers to) and the closing empty lines.
    The join is by digest; where one payload has very many records, Spark splits them among tasks.
    """
    joined = spark.read.parquet(f"{path}/records").join(spark.read.parquet(f"{path}/payloads"), "digest", "left")
    read = arrow(_unpack, joined.select("page_id", "header", "digest", "member"), "page_id long, header string, payload_bytes long, payload_digest string" + ", record binary" * whole, whole)
    value = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)", 1)
    return read.select(
        "page_id", "payload_bytes", "payload_digest", value("WARC-Type").alias("record_type"),
        F.expr(r"try_cast(regexp_extract(header, '\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>', 1) AS bigint)").alias("refers_to"),
        value("WARC-Target-URI").alias("url"), *["record"] * whole,
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
h as (select html, min(page_id) as head from p group by html)
select page_id, cast(n as bigint) as payload_bytes, sha256(html) as payload_digest,
  case when n >= 100 and page_id <> head then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> head then head end as refers_to
from p join h using (html)
"""
