"""The record table of web archives, and what can be asked of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header names in ``headers`` are lower-case. ``http_headers`` keeps order and repetitions. ``offset`` and ``length``
#: are those of the stored (compressed) record. ``error`` is set, and the rest null, where a file could not be read on.
DDL = (
    "warc_uri string, rec_type string, content_type string, headers map<string,string>, http_status_line string, "
    "http_headers array<struct<name:string,value:string>>, payload binary, offset bigint, length bigint, error string"
)

HTML_TYPES = ("text/html", "application/xhtml+xml")
NO_SERVER = "(no server in HTTP header)"
NO_IP = "(no IP address)"
NO_HOST = "(no host name)"


def header(name: str) -> Column:
    """A WARC header of the record, null if absent."""
    return F.try_element_at("headers", F.lit(name.lower()))


def http_values(name: str) -> Column:
    """All values of an HTTP header, in order."""
    chosen = F.filter(F.coalesce("http_headers", F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.lower(h["name"]) == name.lower())
    return F.transform(chosen, lambda h: h["value"])


def _typed(rec_type: str, content_type: str) -> Column:
    return F.coalesce((F.col("rec_type") == rec_type) & (F.col("content_type") == content_type), F.lit(False))


def is_warcinfo() -> Column:
    return _typed("warcinfo", "application/warc-fields")


def is_response() -> Column:
    return F.coalesce(F.col("rec_type") == "response", F.lit(False))


def is_metadata() -> Column:
    return _typed("metadata", "application/warc-fields")


def is_wet_text() -> Column:
    return _typed("conversion", "text/plain")


def is_wat_json() -> Column:
    return _typed("metadata", "application/json")


def is_html() -> Column:
    """HTML by the type that the crawler identified or, whatever that is, by a Content-Type header that names it."""
    identified = F.coalesce(header("WARC-Identified-Payload-Type").isin(*HTML_TYPES), F.lit(False))
    announced = F.exists(http_values("content-type"), lambda v: F.coalesce(F.contains(F.lower(v), F.lit(HTML_TYPES[0])) | F.contains(F.lower(v), F.lit(HTML_TYPES[1])), F.lit(False)))
    return identified | announced


def of_types(*types: str) -> Column:
    """Records of any of these types; the archive source takes this filter over."""
    return F.col("rec_type").isin(*types)


def is_redirect() -> Column:
    return F.coalesce(F.col("http_status_line").rlike(r"^HTTP\s*/\s*1\.[01]\s*30[12378]\b"), F.lit(False))


def is_success() -> Column:
    return F.coalesce(F.col("http_status_line").rlike(r"^HTTP\s*/\s*1\.[01]\s*200\b"), F.lit(False))


def in_robots_file() -> Column:
    return F.coalesce(F.col("warc_uri").contains("/robotstxt/"), F.lit(False))
