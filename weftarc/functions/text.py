"""Words and tags of texts, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of letters, numbers and underscores, lower-cased each by itself."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.lower)


def byte_text(payload: Column) -> Column:
    """Bytes as text, one character each, so that expressions for bytes keep their meaning."""
    return F.decode(payload, "ISO-8859-1")


def tag_names(markup: Column, case_insensitive: bool = False) -> Column:
    """Names after each `<`, as far as they are lower-case letters and digits."""
    return F.regexp_extract_all(F.lower(markup) if case_insensitive else markup, F.lit("<([a-z0-9]+)"), F.lit(1))


def text_lines(text: Column) -> Column:
    """Lines between line feeds, carriage returns or both."""
    return F.split(text, "\r\n|\r|\n")


def utf8(payload: Column) -> Column:
    """Bytes as text, null where they are not valid UTF-8."""
    return F.try_validate_utf8(payload.cast("string"))
