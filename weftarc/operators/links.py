"""Links between pages and between hosts, from WAT records and from WARC redirects and robots.txt files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc import records as R
from weftarc.functions import text, url, wat

# Meta elements that carry links, and what an absolute or host-carrying link looks like.
META_PROPERTIES = ("og:url", "og:image", "og:image:secure_url", "og:video", "og:video:url", "og:video:secure_url", "twitter:url", "twitter:image:src")
META_NAMES = ("twitter:image", "thumbnail", "application-url", "msapplication-starturl", "msapplication-TileImage", "vb_meta_bburl")
ABSOLUTE = r"^(?:https?:)?//"
GLOBAL = r"(?i)^(?:[a-z][a-z0-9]{1,5}:)?//"


def _none() -> Column:
    return F.array().cast("array<string>")


def _absolute(c: Column) -> Column:
    return F.coalesce(c.rlike(ABSOLUTE), F.lit(False))


def _urls(items: Column, attribute: str, other: str | None = None) -> Column:
    """Of a list of elements, the links; null if there is no list."""
    one = lambda x: F.coalesce(x[attribute], F.when(_absolute(x[other]), x[other])) if other else x[attribute]
    return F.filter(F.transform(items, one), lambda v: v.isNotNull())


def location() -> Column:
    """The first Location of a response, up to white space."""
    return F.nullif(F.regexp_extract(F.get(R.http_values("location"), 0), r"^\s*(\S+)", 1), F.lit(""))


def _sitemaps() -> Column:
    """What the lines of a robots.txt announce, if it is UTF-8."""
    lines = F.transform(text.text_lines(text.byte_text(F.col("payload"))), lambda line: F.regexp_extract(line, r"^(?i:sitemap):\s*(\S+)", 1))
    found = F.transform(F.filter(lines, lambda m: m != ""), lambda m: F.try_validate_utf8(F.encode(m, "ISO-8859-1").cast("string")))
    return F.filter(found, lambda v: v.isNotNull())


def captures(records: DataFrame) -> DataFrame:
    """A row for each WAT record of a response and each WARC response: (uri, base, header_links, groups, announced).

    header_links: links of the page's own host, as they stand: in HTTP headers, and where a redirect goes.
    groups: lists of links that belong together: link elements, each meta element with a link, scripts, anchors.
    announced: sitemaps of a robots.txt file. One pass over the records gives all of it.
    """
    rows = records.filter(R.is_wat_json() | R.is_response()).withColumn("wat", F.when(R.is_wat_json(), wat.parsed(F.col("payload"))))
    meta = ("Envelope", "WARC-Header-Metadata")
    of_response = wat.text_at(F.col("wat"), *meta, "WARC-Type") == "response"
    rows = rows.filter(R.is_response() | F.coalesce(of_response, F.lit(False)))
    moved = F.when(R.is_redirect() & ~(R.in_robots_file() & R.is_success()), F.filter(F.array(location()), lambda v: v.isNotNull()))
    rows = rows.select(
        F.when(R.is_response(), R.header("WARC-Target-URI")).otherwise(wat.text_at(F.col("wat"), *meta, "WARC-Target-URI")).alias("uri"), wat.headers(F.col("wat")).alias("h"), wat.html(F.col("wat")).alias("m"),
        F.when(R.is_response(), moved).alias("moved"), F.when(R.is_response() & R.in_robots_file() & R.is_success(), _sitemaps()).alias("announced"),
    )
    in_link = F.flatten(F.transform(wat.named(F.col("h"), "link"), lambda v: F.regexp_extract_all(v, F.lit("<([^>]*)>"), F.lit(1))))
    head = F.col("m.Head")
    listed = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    carries = lambda m: listed(m["property"], META_PROPERTIES) | listed(m["name"], META_NAMES) | _absolute(m["content"])
    metas = F.transform(F.filter(head["Metas"], carries), lambda m: F.filter(F.array(m["content"]), lambda v: v.isNotNull()))
    groups = F.concat(F.array(_urls(head["Link"], "url")), F.coalesce(metas, F.array().cast("array<array<string>>")), F.array(_urls(head["Scripts"], "url"), _urls(F.col("m.Links"), "url", "href")))
    return rows.select(
        "uri", F.when(head["Base"].isNotNull(), url.joined(F.col("uri"), head["Base"])).alias("base"),
        F.concat(F.coalesce("moved", _none()), wat.named(F.col("h"), "content-location"), in_link).alias("header_links"), F.filter(groups, lambda g: g.isNotNull()).alias("groups"), F.coalesce("announced", _none()).alias("announced"),
    )


def page_links_of(pages: DataFrame, resolve_headers: bool = False) -> DataFrame:
    """(s, t) of the rows that captures() gives, not yet distinct. A group without links, and a page without any, links to itself."""
    base = F.coalesce(F.nullif("base", F.lit("")), F.col("uri"))
    pair = lambda t, join: F.struct(t.alias("t"), join.alias("join"))
    from_headers = F.transform("header_links", lambda v: pair(v, F.lit(resolve_headers)))
    from_groups = F.flatten(F.transform("groups", lambda g: F.when(F.size(g) > 0, F.transform(g, lambda v: pair(v, F.lit(True)))).otherwise(F.array(pair(F.col("uri"), F.lit(False))))))
    every = F.concat(from_headers, F.coalesce(from_groups, F.array().cast("array<struct<t:string,join:boolean>>")))
    every = F.when(F.size(every) > 0, every).otherwise(F.array(pair(F.col("uri"), F.lit(False))))
    rows = pages.select("uri", base.alias("base"), F.explode(every).alias("x")).select("uri", "base", "x.t", "x.join")
    whole = F.col("t").rlike(r"^https?://[A-Za-z0-9.-]+(?::[0-9]+)?/[A-Za-z0-9_~%!$&'()*+,;=:@/?-]*$") & ~F.col("t").rlike(r"/\.\.?(/|$)|//.*//")
    simple = F.col("t").rlike(r"^/[A-Za-z0-9_~%-]+(?:[/][A-Za-z0-9_~%-]+)*/?$")
    authority = F.regexp_extract("base", r"^(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)(?:[/?#]|$)", 1)
    joined = F.when(~F.col("join") | whole, F.col("t")).when(simple & (authority != ""), F.concat(authority, F.col("t"))).otherwise(url.joined(F.col("base"), F.col("t")))
    return rows.select(F.col("uri").alias("s"), joined.alias("t")).filter("t IS NOT NULL")


def host_links_of(pages: DataFrame, simple_only: bool = False) -> DataFrame:
    """(s, t) of reversed hosts, of the rows that captures() gives, once for each, in one pass over them.

    Links with a host stand for themselves. Other links of a group together stand for the base, where there is one. A
    header link belongs to the page's own host; for other links, the base's host steps in where the page has none. A
    capture without an edge is one from its host to itself, whatever other captures of its URL have.
    """
    is_global = lambda v: F.coalesce(v.rlike(GLOBAL), F.lit(False))
    has_base = F.coalesce(F.col("base") != "", F.lit(False))
    inner = F.when(has_base & F.exists("groups", lambda g: F.exists(g, lambda v: ~is_global(v))), F.array("base")).otherwise(_none())
    rows = pages.select("uri", "base", F.array_distinct(F.concat("header_links", "announced")).alias("own_links"), F.array_distinct(F.concat(F.filter(F.flatten("groups"), is_global), inner)).alias("group_links"))
    # hosts of all URLs of a capture at once: its own, its base's, then those of both kinds of links
    every = F.concat(F.array("uri", "base"), "own_links", "group_links")
    rows = url.with_surts(rows.select(F.size("own_links").alias("n"), every.alias("hosts")), "hosts", simple_only)
    own, source = F.get("hosts", F.lit(0)), F.coalesce(F.get("hosts", F.lit(0)), F.get("hosts", F.lit(1)))
    pair = lambda s, t: F.struct(s.alias("s"), t.alias("t"))
    pairs = F.concat(F.transform(F.slice("hosts", F.lit(3), F.col("n")), lambda t: pair(own, t)), F.transform(F.slice("hosts", F.col("n") + 3, F.size("hosts")), lambda t: pair(source, t)))
    edges = F.array_distinct(F.filter(pairs, lambda x: F.coalesce(x["s"] != x["t"], F.lit(False))))
    rows = rows.select(own.alias("own"), edges.alias("edges"))
    found = F.when(F.size("edges") > 0, F.col("edges")).when(F.col("own").isNotNull(), F.array(pair(F.col("own"), F.col("own"))))
    return rows.select(F.explode(found).alias("x")).select("x.s", "x.t")


def host_edges(pages: DataFrame, simple_only: bool = False) -> DataFrame:
    """Distinct (s, t) of reversed hosts."""
    return host_links_of(pages, simple_only).distinct()


def page_links(records: DataFrame, resolve: bool = False) -> DataFrame:
    """Distinct (s, t) of pages, of all records; resolve: header and redirect targets are joined to the base."""
    return page_links_of(captures(records), resolve).distinct()


def host_links(records: DataFrame) -> DataFrame:
    """Distinct (s, t) of reversed hosts, of all records."""
    return host_edges(captures(records))
