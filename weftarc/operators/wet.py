"""Text archives (WET) of captures: one for each WARC file, with the places of its records."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weftarc import sinks
from weftarc.functions.html import to_text
from weftarc.records import HTML_TYPES
from weftarc.sources import uri as uris
from weftarc.sources.warcfile import Record, Writer, records

SCHEMA = "uri string, wet_record_location struct<filename:string,offset:bigint,length:bigint>, error string"
ARROW = pa.schema([("uri", pa.string()), ("wet_record_location", pa.struct([("filename", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])), ("error", pa.string())])
# Fixed value: fields of the source's description that are passed on.
KEPT_FIELDS = ("robots", "ispartof", "operator", "description", "publisher")


def wet_name(uri: str) -> str:
    return uri.split("/")[-1].replace(".warc.gz", ".warc.wet.gz")


def fields(body: bytes) -> dict[str, str]:
    """The `name: value` lines of a description or metadata record."""
    out = {}
    for line in body.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name] = value.strip()
    return out


def metadata(body: bytes) -> tuple[str | None, str | None]:
    """Encoding and comma-joined languages that a metadata record tells."""
    found = fields(body)
    try:
        languages = ",".join(x["code-iso-639-3"] for x in json.loads(found.get("languages-cld2", "{}")).get("languages", []))
    except (ValueError, KeyError, TypeError, AttributeError):
        languages = ""
    return found.get("charset-detected"), languages or None


def _is_html(r: Record) -> bool:
    if r.headers.get("warc-identified-payload-type") in HTML_TYPES:
        return True
    return any(n.lower() == "content-type" and any(t in v.lower() for t in HTML_TYPES) for n, v in r.http or ())


def _groups(found: Iterator[Record]) -> Iterator[list[Record]]:
    """Runs of records with one target and date, each with one response at most.

    Captures of one URL in one second are runs of their own: metadata stands behind its response or, where the first does
    so, before it.
    """
    run: list[Record] = []
    for r in found:
        key = (r.headers.get("warc-target-uri"), r.headers.get("warc-date"))
        if run and key != (run[0].headers.get("warc-target-uri"), run[0].headers.get("warc-date")):
            yield run
            run = []
        elif r.rec_type == "response" and (at := next((i for i, x in enumerate(run) if x.rec_type == "response"), None)) is not None:
            cut = at + 1 if at else len(run)
            yield run[:cut]
            run = run[cut:]
        run.append(r)
    if run:
        yield run


def convert(name: str, source, out, mode: str = "layout", empty: bool = False) -> Iterator[dict]:
    """Write the WET file of one WARC stream; a row for each text record. empty: rows of length 0 for captures without HTML."""
    writer = Writer(out)
    file = wet_name(name)
    info: dict[str, str] = {}

    def interesting() -> Iterator[Record]:
        first = True
        for r in records(source, True, frozenset(("warcinfo", "response", "metadata"))):
            about = r.rec_type == "warcinfo"
            if about and first:
                info.update({k: v for k, v in fields(r.payload).items() if k.lower() in KEPT_FIELDS})
            if first:
                body = "".join(f"{k}: {v}\r\n" for k, v in {"software": "weftarc", **info}.items())
                writer.write("warcinfo", body.encode(), "application/warc-fields", headers={"WARC-Filename": file})
            first = False
            if r.rec_type == "response" or r.rec_type == "metadata" and r.content_type == "application/warc-fields":
                yield r

    for run in _groups(interesting()):
        response = next((r for r in reversed(run) if r.rec_type == "response"), None)
        target = run[0].headers.get("warc-target-uri")
        if response is None or not _is_html(response):
            if empty and target:
                yield {"uri": target, "wet_record_location": {"filename": file, "offset": writer.at, "length": 0}, "error": None}
            continue
        encoding, languages = metadata(next((r.payload for r in reversed(run) if r.rec_type == "metadata"), b""))
        announced = next((v for n, v in response.http or () if n.lower() == "content-type"), None)
        text = to_text(response.payload, encoding, mode, announced)
        more = {"WARC-Refers-To": response.headers.get("warc-record-id", "")} | ({"WARC-Identified-Content-Language": languages} if languages else {})
        offset, length = writer.write("conversion", text.encode("utf-8", "replace"), "text/plain", target, response.headers.get("warc-date"), more)
        yield {"uri": target, "wet_record_location": {"filename": file, "offset": offset, "length": length}, "error": None}


EXISTS = "skipped: the output exists"


def extract(manifest: DataFrame, output: str, base: str | None = None, mode: str = "layout", empty: bool = False, skip: bool = False, temp: str | None = None) -> DataFrame:
    """WET files in the folder ``output``, which all executors share, of the WARC files of a manifest (uri).

    skip: a file whose output exists is not read, and has a row with the error EXISTS. temp: a folder of each executor for
    files under way, which are then copied; else they are under way in the output folder. A file is written under another name and then renamed, so that a task that runs again writes it anew and gives the
    same rows, and a reader never sees half of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(output, exist_ok=True)
        for b in batches:
            for name in b.column("uri").to_pylist():
                rows: list[dict] = []
                if skip and sinks.has_file(output, wet_name(name)):
                    yield pa.RecordBatch.from_pylist([{"uri": name, "wet_record_location": None, "error": EXISTS}], ARROW)
                    continue
                fd, part = tempfile.mkstemp(dir=output, prefix=".part-")
                try:
                    with os.fdopen(fd, "wb") as whole, uris.open_range(name, base) as source:
                        with tempfile.TemporaryFile(dir=temp) if temp else contextlib.nullcontext(whole) as out:
                            for row in convert(name, source, out, mode, empty):
                                rows.append(row)
                            if temp:
                                out.seek(0)
                                shutil.copyfileobj(out, whole)
                    os.replace(part, os.path.join(output, wet_name(name)))
                except Exception as e:
                    os.unlink(part)
                    rows = [{"uri": name, "wet_record_location": None, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return manifest.select("uri").mapInArrow(run, SCHEMA)
