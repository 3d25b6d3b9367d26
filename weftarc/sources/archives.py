"""Archive records as DataFrames.

``spark.read.format("warc")`` streams local and web files and those of object stores, one input partition for each (files
of many gigabytes need no memory for more than a record); other stores, which only Spark opens, are read by
from_hadoop(). listed() takes a listing of files in any of these. at_offsets() fetches single records by place, as an
index gives them.

Options of the source: ``path`` (a file, a folder, a glob; more separated by line feeds), or ``manifest`` (a text file of
such names, gzip or plain), ``base`` (put before names without a scheme), ``parsehttp``, ``decode``, ``recordtypes``
(comma-separated), ``partitions`` (at most so many, files being dealt out; else one a file), ``payload`` (false leaves payloads null), ``mode`` (PERMISSIVE: a damaged file gives the records
before the damage and a row with ``error``; FAILFAST raises). With spark.sql.python.filterPushdown.enabled, filters on
``rec_type`` are applied while reading.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from weftarc.records import DDL
from weftarc.sources import uri as uris
from weftarc.sources.warcfile import Record, records

ARROW = pa.schema(
    [
        ("warc_uri", pa.string()), ("rec_type", pa.string()), ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http_status_line", pa.string()),
        ("http_headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary()), ("offset", pa.int64()), ("length", pa.int64()), ("error", pa.string()),
    ]
)
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


def _row(uri: str, r: Record, payload: bool) -> dict:
    return {
        "warc_uri": uri, "rec_type": r.rec_type, "content_type": r.content_type, "headers": list(r.headers.items()), "http_status_line": r.status,
        "http_headers": None if r.http is None else [{"name": n, "value": v} for n, v in r.http], "payload": r.payload if payload else None, "offset": r.offset, "length": r.length, "error": None,
    }


def _failed(uri: str, e: Exception) -> dict:
    return dict.fromkeys(ARROW.names) | {"warc_uri": uri, "error": f"{type(e).__name__}: {e}"}


def _batches(rows: Iterator[dict], schema: pa.Schema = ARROW) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["payload"] or b"") + 500
        if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class Reader(DataSourceReader):
    def __init__(self, options):
        flag = lambda k, default: str(options.get(k, default)).lower() == "true"
        self.options = dict(options)
        self.base = options.get("base")
        self.parse, self.decode, self.payload = flag("parsehttp", "true"), flag("decode", "true"), flag("payload", "true")
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        given = options.get("recordtypes")
        self.types = frozenset(t.strip() for t in given.split(",")) if given else None

    def pushFilters(self, filters):
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("rec_type",) and None not in wanted:
                self.types = frozenset(wanted) if self.types is None else self.types & wanted
            else:
                yield f

    def names(self) -> list[str]:
        if manifest := self.options.get("manifest"):
            with uris.open_range(manifest) as f:
                data = f.read()
            text = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            return [x.strip() for x in text.decode().splitlines() if x.strip()]
        out = []
        for p in (self.options.get("path") or "").split("\n"):
            place = uris.resolve(p, self.base)
            if place.scheme not in ("", "file"):
                out.append(place.uri)
            elif os.path.isdir(place.path):
                out += sorted(f for f in glob.glob(os.path.join(place.path, "*")) if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_")))
            else:
                out += sorted(glob.glob(place.path)) or ([place.path] if p else [])
        return out

    def partitions(self):
        names = self.names()
        n = min(int(self.options.get("partitions", len(names))) or 1, len(names))
        return [Files(names[i::n]) for i in range(n)]

    def read(self, partition):
        yield from _batches(row for name in partition.names for row in _rows_of(name, self.base, self.parse, self.types, self.decode, self.payload, self.strict))


def _rows_of(name: str, base: str | None, parse: bool, types: frozenset | None, decode: bool, payload: bool = True, strict: bool = False) -> Iterator[dict]:
    try:
        with uris.open_range(name, base) as stream:
            for r in records(stream, parse, types, decode):
                yield _row(name, r, payload)
    except Exception as e:
        if strict:
            raise
        yield _failed(name, e)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return DDL

    def reader(self, schema):
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make spark.read.format("warc") known; filters on the record type are pushed down from then on."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str | list[str] | None = None, **options: str) -> DataFrame:
    register(spark)
    r = spark.read.format("warc").options(**options)
    return r.load("\n".join([path] if isinstance(path, str) else path)) if path else r.load()


def manifest(spark: SparkSession, path: str, partitions: int = 400) -> DataFrame:
    """(uri) of a listing, dealt out evenly."""
    return spark.read.text(path).select(F.trim("value").alias("uri")).filter("uri <> ''").repartition(partitions)


def _parsed(batches: Iterator[pa.RecordBatch], parse: bool, types: frozenset | None, decode: bool) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    for r in records(io.BytesIO(content.as_buffer()), parse, types, decode):
                        yield _row(name, r, True)
                except Exception as e:
                    yield _failed(name, e)

    yield from _batches(rows())


def from_hadoop(spark: SparkSession, path: str | list[str], parse_http: bool = True, types: list[str] | None = None, decode: bool = True) -> DataFrame:
    """Records of archives in any store that Spark reads; each file is read whole, so files must be under 2 GB."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda it: _parsed(it, parse_http, frozenset(types) if types else None, decode), DDL)


def of_listing(uri_rows: DataFrame, base: str | None = None, parse_http: bool = True, types: list[str] | None = None, decode: bool = True) -> DataFrame:
    """Records of the files that rows (uri) name, in a batch or in a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = frozenset(types) if types else None
        yield from _batches(row for b in batches for name in b.column("uri").to_pylist() for row in _rows_of(name, base, parse_http, wanted, decode))

    return uri_rows.select("uri").mapInArrow(run, DDL)


def _scheme(name: Column, base: str | None) -> Column:
    """The scheme of a name of a listing, or of the base before it."""
    own = F.regexp_extract(name, r"^([a-z0-9]+):", 1)
    known = own.isin(*uris.BY_PYTHON[1:], "hdfs", "viewfs", "abfs", "abfss")
    return F.when(known, own).otherwise(F.lit(uris.resolve("", base).scheme if base else ""))


def listed(spark: SparkSession, listing: str, base: str | None = None, partitions: int = 400, types: list[str] | None = None) -> DataFrame:
    """Records of the files that a listing, in any store, names: streamed where Python opens them, else by from_hadoop()."""
    names = manifest(spark, listing, partitions).withColumn("scheme", _scheme(F.col("uri"), base))
    by_python = F.col("scheme").isin(*uris.BY_PYTHON)
    others = [uris.resolve(r["uri"], base).uri for r in names.filter(~by_python).select("uri").collect()]  # names, which Spark's reader takes as a list
    found = of_listing(names.filter(by_python), base, types=types)
    return found.unionByName(from_hadoop(spark, others, types=types)) if others else found


COORDINATES = ["url", "warc_filename", "warc_record_offset", "warc_record_length"]


def _fetched(batches: Iterator[pa.RecordBatch], base: str | None, parse: bool, decode: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*ARROW, ("url", pa.string()), ("content_charset", pa.string())])

    def rows() -> Iterator[dict]:
        for b in batches:
            names = b.schema.names
            for c in b.to_pylist():
                more = {"url": c["url"], "content_charset": c.get("content_charset")}
                try:
                    if "part" in names:
                        stream = io.BytesIO(c["part"] or b"")
                    else:
                        stream = uris.open_range(c["warc_filename"], base, c["warc_record_offset"], c["warc_record_length"])
                    with stream:
                        for r in records(stream, parse, None, decode):
                            r.offset, r.length = c["warc_record_offset"], c["warc_record_length"]
                            if more["content_charset"]:
                                r.headers["warc-identified-content-charset"] = more["content_charset"]
                            yield _row(c["warc_filename"], r, True) | more
                except Exception as e:
                    yield _failed(c["warc_filename"], e) | more

    yield from _batches(rows(), schema)


BROADCAST = 200_000  # places


def _qualified(spark: SparkSession, name: str) -> str:
    """A path as Spark's reader gives it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def at_offsets(coordinates: DataFrame, base: str | None = None, partitions: int | None = None, parse_http: bool = True, decode: bool = True, hadoop: bool | None = None) -> DataFrame:
    """Records at the places in coordinates (url, warc_filename, warc_record_offset, warc_record_length[, content_charset]).

    A row that cannot be fetched gives a row with ``error``. Rows are sorted by file and offset within partitions, so
    that reads go forward. hadoop: files are read by Spark, whole, and cut by an expression; unless given, where the base
    is in a store that only Spark reads.
    """
    if hadoop is None:
        hadoop = uris.resolve("", base).scheme not in uris.BY_PYTHON if base else False
    spark = coordinates.sparkSession
    columns = COORDINATES + [c for c in ("content_charset",) if c in coordinates.columns]
    rows = coordinates.select(*columns)
    if hadoop:
        names = [r[0] for r in rows.select("warc_filename").distinct().collect()]  # a row a file
        paths = spark.createDataFrame([(n, _qualified(spark, uris.resolve(n, base).uri)) for n in names], "warc_filename string, path string")
        files = spark.read.format("binaryFile").load([r["path"] for r in paths.collect()]).select("path", "content")
        placed = rows.join(F.broadcast(paths), "warc_filename")
        # rather places than archives to where the others are
        placed = F.broadcast(placed) if rows.count() <= BROADCAST else placed
        part = F.substring(F.col("content"), F.col("warc_record_offset").cast("int") + 1, F.col("warc_record_length").cast("int"))
        rows = files.join(placed, "path").select(*columns, part.alias("part"))
    elif partitions:
        rows = rows.repartition(partitions)
    if not hadoop:
        rows = rows.sortWithinPartitions("warc_filename", "warc_record_offset")
    return rows.mapInArrow(lambda it: _fetched(it, base, parse_http, decode), DDL + ", url string, content_charset string")
