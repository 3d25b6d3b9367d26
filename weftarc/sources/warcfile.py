"""Reading and writing of WARC files, and reading of ARC files, as streams: one record is in memory at a time."""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import BinaryIO

CHUNK = 1 << 16


@dataclass
class Record:
    rec_type: str | None
    content_type: str | None
    headers: dict[str, str]
    payload: bytes
    status: str | None = None
    http: list[tuple[str, str]] | None = None
    offset: int = 0
    length: int = 0
    extra: dict = field(default_factory=dict)


class _Source:
    """A stream with push-back that knows where it is."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.buffer, self.next, self.at = stream, bytearray(), 0, 0

    def more(self) -> bool:
        """Read on; what was taken leaves the buffer first, so that each byte is moved a few times at most."""
        got = self.stream.read(max(CHUNK, len(self.buffer) - self.next))
        if self.next:
            del self.buffer[: self.next]
            self.next = 0
        self.buffer += got
        return bool(got)

    def left(self) -> int:
        return len(self.buffer) - self.next

    def peek(self, n: int) -> bytes:
        while self.left() < n and self.more():
            pass
        return bytes(self.buffer[self.next : self.next + n])

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.next += len(out)
        self.at += len(out)
        return out

    def rest(self) -> bytes:
        """All that is in the buffer."""
        return self.take(self.left())

    def back(self, data: bytes) -> None:
        """Give back what was taken last."""
        self.buffer[: self.next] = data
        self.next = 0
        self.at -= len(data)

    def line(self) -> bytes:
        seen = 0
        while (end := self.buffer.find(b"\n", self.next + seen)) < 0:
            seen = self.left()
            if not self.more():
                return self.rest()
        return self.take(end + 1 - self.next)


def _members(source: _Source) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and contents of each gzip member."""
    while source.peek(1):
        start, z, out = source.at, zlib.decompressobj(31), []
        while not z.eof:
            if not source.left() and not source.more():
                raise EOFError("the last gzip member is cut off")
            out.append(z.decompress(source.rest()))
            source.back(z.unused_data)
        yield start, source.at - start, b"".join(out)


def _headers(source: _Source) -> list[tuple[str, str]]:
    """Header lines up to an empty one; folded lines are joined."""
    found: list[list[str]] = []
    while (line := source.line()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and found:
            found[-1][1] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            found.append([name.strip(), value.strip()])
    return [(n, v) for n, v in found]


class _Bytes(_Source):
    def __init__(self, data: bytes):
        self.buffer, self.next, self.at = data, 0, 0

    def more(self) -> bool:
        return False


def _one(source: _Source) -> Record | None:
    """The record that begins here, or null at the end."""
    while (line := source.line()) and not line.strip():
        pass
    if not line:
        return None
    if line.startswith(b"WARC/"):
        headers = {n.lower(): v for n, v in _headers(source)}
        size = int(headers.get("content-length") or 0)
        body = source.take(size)
        if len(body) < size:
            raise EOFError("a record is cut off")
        return Record(headers.get("warc-type"), headers.get("content-type"), headers, body)
    return _arc(line, source)


def _arc(line: bytes, source: _Source) -> Record:
    """An ARC record: URL, address, date, type and size on a line. The first of a file describes it."""
    parts = line.decode("utf-8", "replace").split()
    if len(parts) < 5 or not parts[-1].isdigit():
        raise ValueError("neither a WARC nor an ARC record")
    url, address, date, kind, size = parts[0], parts[1], parts[2], parts[3], int(parts[-1])
    body = source.take(size)
    about = url.startswith("filedesc:")
    when = datetime.strptime(date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if date.isdigit() and len(date) >= 8 else date
    headers = {"warc-type": "warcinfo" if about else "response", "warc-target-uri": url, "warc-ip-address": address, "warc-date": when, "content-length": str(size)}
    headers["content-type"] = "application/warc-fields" if about else "application/http; msgtype=response" if body.startswith(b"HTTP/") else kind
    return Record(headers["warc-type"], headers["content-type"], headers, body)


def _dechunked(body: bytes) -> bytes:
    source, out = _Bytes(body), []
    while size := source.line().split(b";")[0].strip():
        n = int(size, 16)
        if not n:
            break
        out.append(source.take(n))
        source.line()
    return b"".join(out)


def _decoded(body: bytes, http: list[tuple[str, str]]) -> bytes:
    """The body without transfer and content encodings; as it is where these are not what they say."""
    names = {n.lower(): v.lower() for n, v in http}
    try:
        if "chunked" in names.get("transfer-encoding", ""):
            body = _dechunked(body)
        coding = names.get("content-encoding", "")
        if "gzip" in coding:
            body = gzip.decompress(body)
        elif "deflate" in coding:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                body = zlib.decompress(body, -15)
    except (ValueError, OSError, EOFError, zlib.error):
        pass
    return body


def _with_http(r: Record, decode: bool) -> Record:
    if r.rec_type in ("response", "request", "revisit") and (r.content_type or "").startswith("application/http"):
        source = _Bytes(r.payload)
        r.status = source.line().decode("utf-8", "replace").rstrip("\r\n")
        r.http = _headers(source)
        body = source.rest()
        r.payload = body if not decode else _decoded(body, r.http)
    return r


def records(stream: BinaryIO, parse_http: bool = True, types: frozenset[str] | None = None, decode: bool = True) -> Iterator[Record]:
    """The records of a WARC or ARC file, compressed by record or not at all, with their places in the file."""
    source = _Source(stream)
    if source.peek(2) == b"\x1f\x8b":
        found = ((start, length, inner) for start, length, data in _members(source) for inner in [_Bytes(data)])
        for start, length, inner in found:
            while r := _one(inner):
                if types is None or r.rec_type in types:
                    r.offset, r.length = start, length
                    yield _with_http(r, decode) if parse_http else r
        return
    while True:
        while source.peek(1) in (b"\r", b"\n"):
            source.take(1)
        start = source.at
        r = _one(source)
        if r is None:
            return
        if types is None or r.rec_type in types:
            r.offset, r.length = start, source.at - start
            yield _with_http(r, decode) if parse_http else r


def _on_a_line(value: str) -> str:
    """A header value whose line breaks, which would end it and with it the headers, are escaped as in a URI."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


class Writer:
    """Writes records, each a gzip member, and tells where."""

    def __init__(self, out: BinaryIO):
        self.out, self.at = out, 0

    def write(self, rec_type: str, payload: bytes, content_type: str, uri: str | None = None, date: str | None = None, headers: dict[str, str] | None = None) -> tuple[int, int]:
        """Offset and length of the written record."""
        lines = [("WARC-Type", rec_type), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rec_type} {uri} {self.at}')}>")]
        lines += [("WARC-Target-URI", uri)] if uri else []
        lines.append(("WARC-Date", date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")))
        given = {k.lower() for k in headers or {}}
        lines = [(k, v) for k, v in lines if k.lower() not in given] + list((headers or {}).items())
        lines += [("Content-Type", content_type), ("Content-Length", str(len(payload)))]
        head = "WARC/1.0\r\n" + "".join(f"{k}: {_on_a_line(v)}\r\n" for k, v in lines) + "\r\n"
        data = gzip.compress(head.encode() + payload + b"\r\n\r\n", 6, mtime=0)
        self.out.write(data)
        start, self.at = self.at, self.at + len(data)
        return start, len(data)
