"""Names of inputs: scheme, place and how to open them."""

from __future__ import annotations

import io
import os
import re
import urllib.request
from typing import BinaryIO, NamedTuple

# Fixed value: URIs with one of the schemes that are read.
KNOWN = re.compile(r"(s3[an]?|https?|file|hdfs|viewfs|abfss?|gs):(?://([^/]*))?/(.*)", re.S)


#: Stores that Arrow's file systems read, in parts too; what is left is Spark's.
STORES = ("s3", "s3a", "s3n", "gs")
BY_PYTHON = ("", "file", "http", "https", *STORES)


class Place(NamedTuple):
    uri: str
    scheme: str
    authority: str
    path: str


def resolve(uri: str, base: str | None = None) -> Place:
    """A URI as it is or, if it has no scheme, with the base put before it; without a scheme then, a local path."""
    found = KNOWN.match(uri)
    if not found and base:
        uri = base + uri
        found = KNOWN.match(uri)
    if not found:
        return Place(uri, "", "", uri)
    path = found[3]
    return Place(uri, found[1], found[2] or "", "/" + path if found[1] == "file" else path)


def store(place: Place):
    """The Arrow file system of a place, with the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", place.uri))


def open_range(uri: str, base: str | None = None, offset: int = -1, length: int = -1) -> BinaryIO:
    """The bytes of a local file, a web file or one in STORES, or of a part of it where both numbers are given.

    Other schemes are Spark's to read: see archives.from_hadoop() and archives.at_offsets(). Raises OSError.
    """
    place = resolve(uri, base)
    part = offset > -1 and length > 0
    if place.scheme in ("http", "https"):
        request = urllib.request.Request(place.uri, headers={"Range": f"bytes={offset}-{offset + length - 1}"} if part else {})
        return urllib.request.urlopen(request, timeout=60)
    if place.scheme in ("", "file"):
        f = open(os.path.abspath(place.path), "rb")
        if not part:
            return f
        with f:
            f.seek(offset)
            return io.BytesIO(f.read(length))
    if place.scheme in STORES:
        system, path = store(place)
        if not part:
            return system.open_input_stream(path, compression=None)
        with system.open_input_file(path) as f:
            f.seek(offset)
            return io.BytesIO(f.read(length))
    raise OSError(f"{place.scheme} is read by Spark only: {uri}")
