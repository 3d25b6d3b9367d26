"""Hosts and joins of URLs. Arrow functions where the rules go beyond expressions, with fast paths for plain ASCII hosts."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a host, a label and an address look like.
PLAIN_URL = re.compile(r"https?://([a-z0-9_.-]{2,253})(?:[/?#]|\Z)", re.I | re.A)
LABEL = re.compile(r"[a-z0-9](?:[a-z0-9_-]{0,61}[a-z0-9])?", re.A)
ADDRESS = re.compile(r"(?:www\.)?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\Z")


def _or_null(f):
    def g(*args):
        if any(a is None for a in args):
            return None
        try:
            return f(*args)
        except (ValueError, UnicodeError):
            return None

    return g


def _ascii_label(label: str) -> str | None:
    """A label as it stands in the DNS, or null."""
    import idna

    if LABEL.fullmatch(label):
        return label
    try:
        encoded = idna.encode(label).decode("ascii")
    except (idna.IDNAError, UnicodeError):
        return None
    return encoded if LABEL.fullmatch(encoded) else None


def surt_host(url: str | None) -> str | None:
    """The host of a URL with its labels reversed, without a leading www; null for addresses, single labels and what no host can be."""
    if url is None:
        return None
    if found := PLAIN_URL.match(url):
        host = found[1]
    else:
        try:
            host = urlparse(url).hostname
        except ValueError:
            return None
    host = (host or "").strip().lower()
    if not 1 <= len(host) <= 253 or ADDRESS.match(host):
        return None
    labels = host.split(".")
    if labels[-1] == "":
        labels.pop()
    if len(labels) < 2:
        return None
    if labels[0] == "www" and len(labels) > 2:
        labels = labels[1:]
    out = []
    for label in labels:
        ascii_label = _ascii_label(label) if len(label) <= 63 else None
        if ascii_label is None:
            return None
        out.append(ascii_label)
    return ".".join(reversed(out))


def hostname(url: str | None) -> str | None:
    return _or_null(lambda u: urlparse(u).hostname)(url)


def robots_host(url: str | None) -> str | None:
    """The authority of a URL in lower case, with port and user, without leading dots."""
    return _or_null(lambda u: urlparse(u).netloc.lower().lstrip("."))(url)


def join(base: str | None, relative: str | None) -> str | None:
    return _or_null(urljoin)(base, relative)


def normalized(name: str | None) -> str | None:
    """A reversed host name with each label as in the DNS; null where a label cannot be."""
    if name is None:
        return None
    labels = [label if LABEL.fullmatch(label) else _idna(label) for label in name.split(".")]
    return None if None in labels else ".".join(labels)


def _idna(label: str) -> str | None:
    import idna

    try:
        return idna.encode(label).decode("ascii")
    except (idna.IDNAError, UnicodeError):
        return None


def _column(f):
    def g(values: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known[v] if v in known else known.setdefault(v, f(v)) for v in values.where(values.notna(), None)], dtype=object)

    g.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(g, "string")


_udfs: dict = {}


def _udf(name: str):
    if name not in _udfs:
        if name == "join":

            @F.pandas_udf("string")
            def joined(base: pd.Series, relative: pd.Series) -> pd.Series:
                none = lambda s: s.where(s.notna(), None)
                return pd.Series([join(b, r) for b, r in zip(none(base), none(relative))], dtype=object)

            _udfs[name] = joined
        elif name == "surt_hosts":

            @F.pandas_udf("array<string>")
            def surts(lists: pd.Series) -> pd.Series:
                return pd.Series([None if x is None else [surt_host(u) for u in x] for x in lists], dtype=object)

            _udfs[name] = surts
        else:
            _udfs[name] = _column(globals()[name])
    return _udfs[name]


#: URLs whose host needs no more than lower case: the scheme, letters, digits, dots and hyphens.
_SIMPLE = r"^(?i:https?)://([A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9])(?:[/?#]|$)"


def host_of(url: Column, simple_only: bool = False) -> Column:
    """hostname() of a URL column; simple_only leaves out what the expression cannot tell (null)."""
    simple = F.lower(F.nullif(F.regexp_extract(url, _SIMPLE, 1), F.lit("")))
    return simple if simple_only else F.coalesce(simple, _udf("hostname")(F.when(simple.isNull(), url)))


def surt_of(url: Column, simple_only: bool = False) -> Column:
    """surt_host() of a URL column; simple_only: by expressions alone, for plain ASCII hosts of several letters-first labels."""
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"

    def reversed_labels(host: Column) -> Column:
        plain = host.rlike(rf"^{label}(?:\.{label})+$") & ~host.rlike(r"^(?:www\.)?[0-9.]+$") & (F.length(host) <= 253)
        return F.when(plain, F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\.(?=[^.]+\.)", ""), r"\.")), "."))

    # through lists, so that each step is computed once
    simple = F.transform(F.array(F.lower(F.regexp_extract(url, _SIMPLE, 1))), reversed_labels)
    found = F.get(simple, 0)
    return found if simple_only else F.coalesce(found, _udf("surt_host")(F.when(found.isNull(), url)))


def with_surts(rows: DataFrame, column: str, simple_only: bool = False) -> DataFrame:
    """rows with a list of URLs as the list of their surt_of(); only those that need more than an expression leave the JVM."""
    simple = F.transform(column, lambda u: F.struct(u.alias("u"), surt_of(u, True).alias("s")))
    if simple_only:
        return rows.withColumn(column, F.transform(simple, lambda x: x["s"]))
    left = F.array_distinct(F.transform(F.filter("_simple", lambda x: x["s"].isNull() & x["u"].isNotNull()), lambda x: x["u"]))
    rows = rows.withColumn("_simple", simple).withColumn("_left", left).withColumn("_found", _udf("surt_hosts")(F.col("_left")))
    every = F.transform("_simple", lambda x: F.coalesce(x["s"], F.get("_found", F.array_position("_left", x["u"]).cast("int") - 1)))
    return rows.withColumn(column, every).drop("_simple", "_left", "_found")


def robots_host_of(url: Column) -> Column:
    return _udf("robots_host")(url)


def joined(base: Column, relative: Column) -> Column:
    return _udf("join")(base, relative)


def normalized_of(name: Column) -> Column:
    """normalized() of reversed names; only those that are not plain ASCII leave the JVM."""
    label = r"[a-z0-9](?:[a-z0-9_-]{0,61}[a-z0-9])?"
    plain = name.rlike(rf"^{label}(?:\.{label})*$")
    return F.when(plain, name).otherwise(_udf("normalized")(F.when(~plain, name)))


def reversed_host(name: Column) -> Column:
    return F.array_join(F.reverse(F.split(name, r"\.")), ".")
