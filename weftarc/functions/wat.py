"""WAT metadata records: JSON of which only the parts used here are typed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header values are text or lists of text, so headers stay variants.
HTML = (
    "struct<Head:struct<Base:string,Link:array<struct<url:string>>,Metas:array<struct<property:string,name:string,content:string>>,Scripts:array<struct<url:string>>>,"
    "Links:array<struct<url:string,href:string>>>"
)


def parsed(payload: Column) -> Column:
    """The record as a variant; null where it is no JSON."""
    return F.try_parse_json(F.try_validate_utf8(payload.cast("string")))


def text_at(record: Column, *path: str) -> Column:
    return F.try_variant_get(record, "$" + "".join(f"['{p}']" for p in path), "string")


def has(record: Column, *path: str) -> Column:
    return F.try_variant_get(record, "$" + "".join(f"['{p}']" for p in path), "variant").isNotNull()


RESPONSE = ("Envelope", "Payload-Metadata", "HTTP-Response-Metadata")


def headers(record: Column) -> Column:
    """map<string,variant> of the HTTP headers; null if there are none."""
    return F.try_variant_get(record, "$" + "".join(f"['{p}']" for p in (*RESPONSE, "Headers")), "map<string,variant>")


def values(header: Column) -> Column:
    """The values of one header, in a list."""
    one = F.try_variant_get(header, "$", "string")
    return F.coalesce(F.try_variant_get(header, "$", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def named(header_map: Column, name: str) -> Column:
    """All values of the headers of this name, whatever its case."""
    chosen = F.filter(F.map_entries(header_map), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.flatten(F.transform(chosen, lambda e: values(e["value"]))), F.array().cast("array<string>"))


def html(record: Column) -> Column:
    """The HTML metadata as a struct of the type HTML; null if there is none."""
    text = F.try_variant_get(record, "$" + "".join(f"['{p}']" for p in (*RESPONSE, "HTML-Metadata")), "string")
    return F.from_json(text, HTML)
