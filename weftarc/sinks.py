"""Writers: tables, sorted edges, text and single files."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftarc.sources import uri
from weftarc.sources.warcfile import Writer

DATE = "2024-01-01T00:00:00Z"
PLACES = pa.schema([("url", pa.string()), ("warc_filename", pa.string()), ("warc_record_offset", pa.int64()), ("warc_record_length", pa.int64())])


def table(df: DataFrame, name: str, partitions: int = 10, format: str = "parquet", compression: str = "gzip", mode: str = "error", **options: str) -> None:
    """Save as a table of a few files. ORC knows gzip as zlib."""
    if format.lower() == "orc" and compression == "gzip":
        compression = "zlib"
    df.coalesce(partitions).write.format(format).option("compression", compression).options(**options).mode(mode).saveAsTable(name)


def edges(df: DataFrame, name: str, partitions: int = 16, **options: str) -> None:
    """Save distinct edges (s, t), sorted within each file."""
    table(df.select("s", "t").distinct().coalesce(partitions).sortWithinPartitions("s", "t"), name, partitions, **options)


def tsv(df: DataFrame, path: str, *columns: str) -> None:
    """Lines of tab-separated columns, in gzip files."""
    df.select(F.concat_ws("\t", *columns)).write.text(path, compression="gzip")


def archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (url, body) as response records, a WARC file for each partition, in a folder that all executors share.

    Gives the places (url, warc_filename, warc_record_offset, warc_record_length). A task that runs again writes its file
    anew, under another name that is then changed, and gives the same places.
    """
    folder = _local(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{TaskContext.get().partitionId():05}.warc.gz"
        os.makedirs(folder, exist_ok=True)
        fd, part = tempfile.mkstemp(dir=folder, prefix=".part-")
        with os.fdopen(fd, "wb") as out:
            w = Writer(out)
            w.write("warcinfo", b"software: weftarc\r\n", "application/warc-fields", date=DATE)
            for b in batches:
                places = [(u, name, *w.write("response", body or b"", "application/http; msgtype=response", u, DATE)) for u, body in zip(b.column("url").to_pylist(), b.column("body").to_pylist())]
                yield pa.RecordBatch.from_pylist([dict(zip(PLACES.names, p)) for p in places], PLACES)
        os.replace(part, os.path.join(folder, name))

    return rows.select("url", "body").mapInArrow(run, "url string, warc_filename string, warc_record_offset long, warc_record_length long")


def has_file(folder: str, name: str) -> bool:
    """Whether a local folder, or one in an object store, has a file of the name."""
    place = uri.resolve(f"{folder.rstrip('/')}/{name}")
    if place.scheme in uri.STORES:
        from pyarrow import fs

        system, path = uri.store(place)
        return system.get_file_info(path).type == fs.FileType.File
    return os.path.exists(os.path.join(_local(folder), name))


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write a file whole or not at all, to a local folder or one in an object store; gives its name."""
    place = uri.resolve(f"{folder.rstrip('/')}/{name}")
    if place.scheme in uri.STORES:
        system, path = uri.store(place)
        with system.open_output_stream(path, compression=None) as f:  # objects appear when they are closed
            f.write(data)
        return place.uri
    folder = _local(folder)
    os.makedirs(folder, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=folder, prefix=".part-")
    with os.fdopen(fd, "wb") as f:
        f.write(data)
    os.replace(part, os.path.join(folder, name))
    return os.path.join(folder, name)


def _local(folder: str) -> str:
    if folder.startswith(("http:", "https:")):
        raise ValueError("files cannot be written to the web")
    if "://" in folder and not folder.startswith("file:"):
        raise NotImplementedError(f"mount the store, or write a table: {folder}")
    return folder.removeprefix("file://").removeprefix("file:")
