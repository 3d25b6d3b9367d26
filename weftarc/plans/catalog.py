"""Queries over the test tables and the SQL that DuckDB answers them with.

The tables have no archive records, so these are made from ``pages`` by fixed rules on the page id, the same in both
languages: a response record for each page, or the JSON of its WAT record.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftarc import records as R
from weftarc import shared, sinks
from weftarc.functions import url
from weftarc.operators import counts, files, graph, index, links, sitemaps, wet
from weftarc.plans import passthrough
from weftarc.sources import archives, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its SQL where there is one."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# records of pages

HEADERS = "array<struct<name:string,value:string>>"


def responses(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """A response record for each page, with more columns of the page."""
    pages = table(spark, sf_dir, "pages")
    server = F.expr(
        """CASE page_id % 4 WHEN 0 THEN array(named_struct('name', 'Date', 'value', 'now'))
        WHEN 1 THEN array(named_struct('name', 'Server', 'value', concat('nginx/', page_id % 3)))
        WHEN 2 THEN array(named_struct('name', 'server', 'value', 'Apache'), named_struct('name', 'Server', 'value', 'Apache'), named_struct('name', 'SERVER', 'value', 'proxy'))
        ELSE array(named_struct('name', 'Server', 'value', '')) END"""
    )
    kind = F.expr(f"array(named_struct('name', 'Content-Type', 'value', IF(page_id % 10 = 9, 'application/pdf', 'text/html; charset=utf-8')))")
    ip = F.expr("IF(page_id % 5 = 0, NULL, concat('10.0.', page_id % 7, '.', page_id % 3))")
    named = F.map_filter(F.create_map(F.lit("warc-target-uri"), F.col("url"), F.lit("warc-ip-address"), ip, F.lit("warc-identified-payload-type"), F.expr("IF(page_id % 20 = 19, 'text/html', NULL)")), lambda _, v: v.isNotNull())
    status = F.expr("CASE WHEN page_id % 11 = 10 THEN 'HTTP/1.1 302 Found' ELSE 'HTTP/1.1 200 OK' END")
    return pages.select(
        F.lit("file:/crawl/robotstxt/0.warc.gz").alias("warc_uri"), F.lit("response").alias("rec_type"), F.lit("application/http").alias("content_type"), named.alias("headers"),
        status.alias("http_status_line"), F.concat(server, kind).cast(HEADERS).alias("http_headers"), F.encode("html", "UTF-8").alias("payload"),
        F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("error"), *more,
    )


def wat_records(pages: DataFrame, envelope: str) -> DataFrame:
    """WAT records whose JSON is the SQL expression's struct over the columns of pages."""
    return pages.select(
        F.lit("file:/crawl/wat/0.warc.wat.gz").alias("warc_uri"), F.lit("metadata").alias("rec_type"), F.lit("application/json").alias("content_type"), F.create_map(F.lit("warc-target-uri"), F.col("url")).alias("headers"),
        F.lit(None).cast("string").alias("http_status_line"), F.lit(None).cast(HEADERS).alias("http_headers"), F.encode(F.expr(f"to_json({envelope})"), "UTF-8").alias("payload"),
        F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("error"),
    )


def _envelope(response: str) -> str:
    return f"named_struct('Envelope', named_struct('WARC-Header-Metadata', named_struct('WARC-Type', 'response', 'WARC-Target-URI', url), 'Payload-Metadata', named_struct('HTTP-Response-Metadata', {response})))"


def href_wats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAT records with the links that stand in the pages."""
    made = _envelope(r"""named_struct('HTML-Metadata', named_struct('Links', transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), x -> named_struct('path', 'A@/href', 'url', x))))""")
    return wat_records(table(spark, sf_dir, "pages"), made)


def cross_wats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAT records in which page k of n links to pages (7k + 1) mod n and (3k + 2) mod n, those of page 10k to none but one of its own site."""
    pages = table(spark, sf_dir, "pages")
    n = pages.count()
    to = F.when(F.col("page_id") % 10 == 0, F.array().cast("array<bigint>")).otherwise(F.array((F.col("page_id") * 7 + 1) % n, (F.col("page_id") * 3 + 2) % n))
    asked = pages.select("page_id", F.explode(to).alias("to")).join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("link")), "to")
    found = asked.groupBy("page_id").agg(F.collect_list("link").alias("found"))  # two at most
    both = pages.join(found, "page_id", "left").withColumn("found", F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array(F.lit("/own"))))
    return wat_records(both, _envelope("named_struct('HTML-Metadata', named_struct('Links', transform(found, x -> named_struct('url', x))))"))


HOST = "lower(regexp_extract(url, '^(?:https?)://([A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9])(?:[/?#]|$)', 1))"
SURT = "array_to_string(list_reverse(case when len(string_split({0}, '.')) > 2 and string_split({0}, '.')[1] = 'www' then string_split({0}, '.')[2:] else string_split({0}, '.') end), '.')".format(HOST)
CROSS = f"""hosts as (select page_id, {SURT} as h from pages), found as (select a.page_id, a.h as s, b.h as t from hosts a join hosts b on (b.page_id = (a.page_id * 7 + 1) % (select count(*) from pages) or b.page_id = (a.page_id * 3 + 2) % (select count(*) from pages)) where a.page_id % 10 <> 0 and a.h <> b.h),
cross_ as (select s, t from found union select h, h from hosts where page_id not in (select page_id from found))"""
#: Words of the text that is left of markup: everywhere a new word where a tag stands, or only at blocks.
_TEXT = r"regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'gs'), '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g')"
_RAW = r"regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'gs')"
_WORDS = r"select lower(w) as key, count(*) as tf, count(distinct page_id) as df from (select page_id, unnest(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')) as w from pages where {1}) group by 1"
WORDS = _WORDS.format(_TEXT.format(_RAW), "true")
WORDS_OF_HTML = _WORDS.format(_TEXT.format(_RAW), "page_id % 10 <> 9 or page_id % 20 = 19")
WORDS_OF_BLOCKS = _WORDS.format(_TEXT.format(rf"regexp_replace({_RAW}, '</?(a|b|i|em|span|strong|code|html|head|meta|body|button|label|input|select|option|img)(\s[^>]*)?>', '', 'gs')"), "true")
NAMES = "names as (select s as name from cross_ union select t from cross_), ids as (select name, row_number() over (order by name) - 1 as id from names)"


@query("word_count", r"select lower(w) as key, count(*) as tf, count(distinct doc_id) as df from (select doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as w from documents) group by 1")
def _(spark, sf_dir):
    return counts.word_frequencies(tables.spread(table(spark, sf_dir, "documents")))


@query("word_count_by_lang", r"select lang, lower(w) as key, count(*) as tf, count(distinct doc_id) as df from (select lang, doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as w from documents join labels using (doc_id) where quality = 1) group by 1, 2")
def _(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return counts.word_frequencies(tables.spread(table(spark, sf_dir, "documents")).join(good, "doc_id"), "text", "lang")


@query("tag_count", "select t as key, count(*) as val from (select unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) as t from pages where page_id % 10 <> 9 or page_id % 20 = 19) group by 1")
def _(spark, sf_dir):
    return counts.tag_count(responses(spark, sf_dir))


@query("server_count", """select key, count(*) as val from (select unnest(case page_id % 4 when 1 then ['nginx/' || (page_id % 3)] when 2 then ['Apache', 'proxy'] else ['(no server in HTTP header)'] end) as key from pages) group by 1""")
def _(spark, sf_dir):
    return counts.server_count(responses(spark, sf_dir))


@query("wat_server_count", """select key, count(*) as val from (select unnest(case page_id % 3 when 0 then ['a', 'a'] when 1 then ['b/' || (page_id % 5)] else ['(no server in HTTP header)'] end) as key from pages) group by 1""")
def _(spark, sf_dir):
    headers = "from_json(CASE page_id % 3 WHEN 0 THEN '{\"server\":[\" a\",\"a \"]}' WHEN 1 THEN concat('{\"Server\":\"b/', page_id % 5, '\"}') ELSE '{\"Date\":\"now\"}' END, 'map<string,string>')"
    plain = wat_records(table(spark, sf_dir, "pages"), _envelope(f"named_struct('Headers', {headers})"))
    # from_json gives lists as text; make them lists again
    text = F.regexp_replace(F.regexp_replace(F.decode("payload", "UTF-8"), r'"\[(.*?)\]"', r"[$1]"), r'\\"', '"')
    return counts.server_count(plain.withColumn("payload", F.encode(text, "UTF-8")))


@query("server_ip_count", f"""select {HOST} as host, case when page_id % 5 = 0 then '(no IP address)' else '10.0.' || (page_id % 7) || '.' || (page_id % 3) end as ip, count(*) as cnt from pages group by 1, 2""")
def _(spark, sf_dir):
    return counts.server_ip_count(responses(spark, sf_dir))


@query("host_count", f"select {HOST} as host, count(*) as n from pages group by 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(url.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("surt_host", f"select page_id, {SURT} as host from pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.surt_of(F.col("url")).alias("host"))


@query("page_links", """with l as (select url, unnest(case when len(x) > 0 then x else [null] end) as href from (select url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as x from pages))
select distinct url as s, case when href is null then url else regexp_extract(url, '^(https?://[^/?#]*)', 1) || href end as t from l""")
def _(spark, sf_dir):
    return links.page_links(href_wats(spark, sf_dir))


@query("host_links", f"with {CROSS} select s, t from cross_")
def _(spark, sf_dir):
    return links.host_links(cross_wats(spark, sf_dir))


@query("redirect_links", """select distinct url as s, case when page_id % 11 = 10 then '/login?next=' || (page_id % 7) else url end as t from pages""")
def _(spark, sf_dir):
    moved = F.when(F.col("http_status_line").contains("302"), F.concat("http_headers", F.array(F.struct(F.lit("location").alias("name"), F.concat(F.lit(" /login?next="), (F.col("page_id") % 7).cast("string"), F.lit(" ")).alias("value"))))).otherwise(F.col("http_headers"))
    return links.page_links(responses(spark, sf_dir, "page_id").withColumn("http_headers", moved))


@query("graph_vertices", f"with {CROSS}, {NAMES} select name, id from ids")
def _(spark, sf_dir):
    return graph.vertices(links.host_edges(links.captures(cross_wats(spark, sf_dir))), normalize=True, validate=True)


@query("graph_edges", f"with {CROSS}, {NAMES} select a.id as s, b.id as t from cross_ join ids a on a.name = s join ids b on b.name = t where s <> t")
def _(spark, sf_dir):
    edges = links.host_edges(links.captures(cross_wats(spark, sf_dir)))
    return graph.edges_of_ids(edges, graph.vertices(edges))


@query("graph_text", f"with {CROSS}, {NAMES} select id || chr(9) || name as line from ids")
def _(spark, sf_dir):
    ids = graph.vertices(links.host_edges(links.captures(cross_wats(spark, sf_dir))))
    return ids.select(F.concat_ws("\t", "id", "name").alias("line"))


@query("tld_filter", f"with n as (select distinct {SURT} as name from pages), m as (select name from n union all select 'x9.' || name from n union all select 'de' from n union all select 'fr.' || name from n) select distinct name from m where contains(name, '.') and string_split(name, '.')[1] in ('com', 'net', 'org', 'fr')")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "pages").select(url.surt_of(F.col("url"), simple_only=True).alias("name")).distinct()
    more = n.select(F.explode(F.array("name", F.concat(F.lit("x9."), "name"), F.lit("de"), F.concat(F.lit("fr."), "name"))).alias("name")).distinct()
    return graph.valid_hosts(more)


@query("tld_join", f"with n as (select distinct {SURT} as name from pages) select name from n where string_split(name, '.')[1] in ('com', 'org')")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "pages").select(url.surt_of(F.col("url"), simple_only=True).alias("name")).distinct()
    return graph.valid_hosts(n, spark.range(2).select(F.when(F.col("id") == 0, "com").otherwise("org").alias("tld")))


@query("link_map_import", f"with {CROSS} select distinct s, t from cross_")
def _(spark, sf_dir):
    edges = links.host_edges(links.captures(cross_wats(spark, sf_dir)))
    folder = shared.folder(spark, "edges")
    edges.select(F.concat_ws("\t", "s", "t")).write.text(folder)
    return tables.tsv_edges(spark, folder).distinct()


@query("sitemaps", f"""with r as (select 'http://' || {HOST} || '/robots.txt' as u, {HOST} as host, page_id from pages),
m as (select 'http://maps.example.org/' || (page_id % 13) || '.xml' as sitemap_url, host from r union all select 'http://' || host || '/s' || (page_id % 5) || '.xml', host from r)
select sitemap_url, string_agg(host, ' ' order by host) as hosts from m group by 1""")
def _(spark, sf_dir):
    return sitemaps.sitemaps(robots(spark, sf_dir)).select("sitemap_url", F.array_join("hosts", " ").alias("hosts"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt responses: one absolute and one relative sitemap, and one that is no UTF-8."""
    pages = table(spark, sf_dir, "pages")
    body = F.concat(
        F.encode(F.concat(F.lit("User-agent: *\r\nDisallow:\r\n  SITEMAP: http://maps.example.org/"), (F.col("page_id") % 13).cast("string"), F.lit(".xml and more\nsitemap:/s"), (F.col("page_id") % 5).cast("string"), F.lit(".xml\nSitemap: /bad")), "UTF-8"),
        F.unhex(F.lit("E90A")),
    )
    own = F.concat(F.lit("http://"), url.host_of(F.col("url"), simple_only=True), F.lit("/robots.txt"))
    return pages.select(F.lit("response").alias("rec_type"), F.create_map(F.lit("warc-target-uri"), own).alias("headers"), body.alias("payload"))


@query("sitemap_counters", "select count(*) as robots_txt_processed, cast(3 * count(*) as bigint) as sitemap_urls_found, count(*) as sitemap_url_invalid_encoding, count(*) as robots_txt_announcing_sitemap, cast(0 as bigint) as robots_txt_with_more_than_50_sitemaps from pages")
def _(spark, sf_dir):
    return sitemaps.counters(robots(spark, sf_dir))


@query("job_counters", """select count(*) as records_processed, cast(0 as bigint) as warc_input_failed, count(*) as records_response, cast(0 as bigint) as records_response_wat,
  count(*) filter (where page_id % 10 = 9 and page_id % 20 <> 19) as records_non_html, count(*) filter (where page_id % 11 = 10) as records_response_redirect from pages""")
def _(spark, sf_dir):
    return counts.job_counters(responses(spark, sf_dir))


@query("text_md5", "select 'doc/' || doc_id as uri, md5(text) as md5 from documents")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return files.md5(docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")))


@query("json_props", "select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k")).agg(F.count("*").alias("n"))


@query("index_export", "select url, page_id % 4 as shard from pages where url like 'https:%'")
def _(spark, sf_dir):
    return index.query(spark, f"{sf_dir}/pages.parquet", "SELECT url, page_id % 4 AS shard FROM ccindex WHERE url LIKE 'https:%'")


# archives: written from pages, and read again


def _archive(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A shared folder with WARC files of the pages, a file for each split, and the places of their records."""
    folder = shared.folder(spark, "crawl").removeprefix("file://")
    head = F.encode(F.lit("HTTP/1.1 200 OK\r\nServer: nginx\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "UTF-8")
    pages = tables.spread(table(spark, sf_dir, "pages"))
    written = sinks.archives(pages.select("url", F.concat(head, F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("body")), folder)
    written.write.parquet(f"file://{folder}/_places")  # once, as each run would write anew
    return folder, spark.read.parquet(f"file://{folder}/_places")


@query("warc_scan", "select url, md5(html) as payload_md5, octet_length(encode(html)) as bytes from pages")
def _(spark, sf_dir):
    folder, _ = _archive(spark, sf_dir)
    found = archives.read(spark, folder).filter(F.col("rec_type") == "response")
    return found.select(F.col("headers")["warc-target-uri"].alias("url"), F.md5("payload").alias("payload_md5"), F.octet_length("payload").cast("long").alias("bytes"))


@query("warc_listing", "select count(*) as records, cast(sum(octet_length(encode(html))) as bigint) as bytes, cast(0 as bigint) as failed from pages")
def _(spark, sf_dir):
    folder, places = _archive(spark, sf_dir)
    listing = shared.folder(spark, "listing")
    places.select("warc_filename").distinct().write.text(listing)
    found = archives.listed(spark, listing, folder + "/", 8, ["response"])
    return found.agg(F.count("rec_type").alias("records"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"), F.count("error").alias("failed"))


@query("warc_range_fetch", "select url, md5(html) as payload_md5 from pages")
def _(spark, sf_dir):
    folder, places = _archive(spark, sf_dir)
    return index.records(places, folder + "/", 8).select("url", F.md5("payload").alias("payload_md5"))


@query("warc_range_fetch_by_spark", "select url, md5(html) as payload_md5 from pages")
def _(spark, sf_dir):
    folder, places = _archive(spark, sf_dir)
    return index.records(places, folder + "/", 8, hadoop=True).select("url", F.md5("payload").alias("payload_md5"))


@query("index_word_count", WORDS)
def _(spark, sf_dir):
    """Places as CSV, their records, the words of these."""
    folder, places = _archive(spark, sf_dir)
    places.write.csv(f"file://{folder}/_csv", header=True, escape='"')
    found = tables.coordinates(spark, f"file://{folder}/_csv", csv=True, escape='"', multiLine="true")  # URLs may hold quotes and line breaks
    return counts.html_word_count(index.records(found, folder + "/", 8))


def _wet(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A shared folder with the text archives of the pages, and the rows that writing them gave."""
    folder, places = _archive(spark, sf_dir)
    out = shared.folder(spark, "wet").removeprefix("file://")
    names = places.select(F.col("warc_filename").alias("uri")).distinct()
    rows = wet.extract(names.repartition(max(1, names.count())), out, folder + "/")  # a file a task, which adaptive execution leaves so
    rows.write.parquet(f"file://{out}/_places")
    return out, spark.read.parquet(f"file://{out}/_places")


@query("wet_extract", "select url as uri, cast(count(*) as bigint) as n, true as found from pages group by url")
def _(spark, sf_dir):
    """Each text record read again from its place: whether it is of the URL that the row names."""
    out, rows = _wet(spark, sf_dir)
    places = rows.select(F.col("uri").alias("url"), F.col("wet_record_location.filename").alias("warc_filename"), F.col("wet_record_location.offset").alias("warc_record_offset"), F.col("wet_record_location.length").alias("warc_record_length"))
    got = index.records(places, out + "/", 8).select(F.col("url").alias("uri"), (F.col("headers")["warc-target-uri"].eqNullSafe(F.col("url")) & R.is_wet_text()).alias("right"))
    return got.groupBy("uri").agg(F.count("*").alias("n"), F.min("right").alias("found"))


@query("wet_word_count", WORDS_OF_BLOCKS)
def _(spark, sf_dir):
    out, _ = _wet(spark, sf_dir)
    return counts.word_count(archives.read(spark, out))


@query("html_word_count", WORDS_OF_HTML)
def _(spark, sf_dir):
    return counts.html_word_count(responses(spark, sf_dir))


@query("html_charsets", WORDS_OF_HTML)
def _(spark, sf_dir):
    """As html_word_count, of pages in UTF-8, in UTF-16 with a mark, and in UTF-16 as the crawler found."""
    rows = responses(spark, sf_dir)
    n = F.pmod(F.xxhash64("payload"), F.lit(3))
    wide = F.encode(F.decode("payload", "UTF-8"), "UTF-16LE")
    named = F.when(n == 2, F.map_concat("headers", F.create_map(F.lit("warc-identified-content-charset"), F.lit("utf-16-le")))).otherwise(F.col("headers"))
    return counts.html_word_count(rows.withColumn("headers", named).withColumn("payload", F.when(n == 1, F.concat(F.unhex(F.lit("FFFE")), wide)).when(n == 2, wide).otherwise(F.col("payload"))))


# predicates, URLs, tables and sinks

KINDS = "CASE page_id % 8 WHEN 0 THEN 'warcinfo' WHEN 1 THEN 'response' WHEN 2 THEN 'metadata' WHEN 3 THEN 'conversion' WHEN 4 THEN 'metadata' WHEN 5 THEN 'request' WHEN 6 THEN 'revisit' ELSE 'conversion' END"


@query("record_kinds", "select case page_id % 8 when 0 then 'info' when 1 then 'response' when 2 then 'fields' when 3 then 'text' when 4 then 'json' else 'none' end as kind, count(*) as n, count(*) filter (where page_id % 8 in (1, 3, 7)) as asked from pages group by 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.expr(KINDS).alias("rec_type"), F.expr("CASE page_id % 8 WHEN 0 THEN 'application/warc-fields' WHEN 2 THEN 'application/warc-fields' WHEN 3 THEN 'text/plain' WHEN 4 THEN 'application/json' WHEN 7 THEN 'text/plain; charset=x' END").alias("content_type"))
    kind = F.when(R.is_warcinfo(), "info").when(R.is_response(), "response").when(R.is_metadata(), "fields").when(R.is_wet_text(), "text").when(R.is_wat_json(), "json").otherwise("none")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(R.of_types("response", "conversion").cast("long")).alias("asked"))


@query("response_status", "select page_id % 6 as k, page_id % 6 in (0, 1) as moved, page_id % 6 = 2 as good, count(*) as n from pages group by 1")
def _(spark, sf_dir):
    line = F.expr("CASE page_id % 6 WHEN 0 THEN 'HTTP/1.1 301 Moved' WHEN 1 THEN 'HTTP/1.0 308' WHEN 2 THEN 'HTTP/1.1 200 OK' WHEN 3 THEN 'HTTP/2 301' WHEN 4 THEN 'HTTP/1.1 404' END")
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 6).alias("k"), line.alias("http_status_line"))
    return rows.groupBy("k", R.is_redirect().alias("moved"), R.is_success().alias("good")).agg(F.count("*").alias("n"))


@query("robots_links", f"with h as (select distinct {SURT} as s from pages) select s, 'org.example.maps' as t from h where s <> 'org.example.maps'")
def _(spark, sf_dir):
    """Hosts linked by the sitemaps of robots.txt files in robots.txt archives."""
    rows = robots(spark, sf_dir).select(
        F.lit("s3://crawl/robotstxt/0.warc.gz").alias("warc_uri"), "rec_type", F.lit("application/http").alias("content_type"), "headers", F.lit("HTTP/1.1 200 OK").alias("http_status_line"),
        F.lit(None).cast(HEADERS).alias("http_headers"), F.encode(F.lit("User-agent: *\nSitemap: http://maps.example.org/1.xml\nSitemap: /own.xml"), "UTF-8").alias("payload"),
    )
    return links.host_links(rows)


@query("link_headers", """select distinct url as s, unnest(['https://b.org/' || (page_id % 9), '/c', '/at']) as t from pages""")
def _(spark, sf_dir):
    made = "named_struct('Headers', named_struct('LINK', concat('<https://b.org/', page_id % 9, '>; rel=preload, </c>; rel=x'), 'Content-Location', '/at'))"
    return links.page_links(wat_records(table(spark, sf_dir, "pages"), _envelope(made)))


AUTHORITY = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


@query("url_joins", f"""select page_id, {AUTHORITY} || '/p/q' as rooted, regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '^(.*/)', 1) || 'r.html?x=1' as beside, regexp_extract(url, '^([^?#]*)', 1) || '?y' as asked,
  regexp_extract(url, '^(https?:)', 1) || '//cdn.org/i' as other, 'https://z.org/' as whole from pages""")
def _(spark, sf_dir):
    to = {"rooted": "/p/q", "beside": "r.html?x=1", "asked": "?y", "other": "//cdn.org/i", "whole": "https://z.org/"}
    return table(spark, sf_dir, "pages").select("page_id", *(url.joined(F.col("url"), F.lit(v)).alias(k) for k, v in to.items()))


@query("host_names", f"select page_id, {SURT} || '.xn--mnchen-3ya' as name, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || ':8' as authority from pages")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    odd = F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), F.lit(":8/robots.txt"))
    return pages.select("page_id", url.normalized_of(F.concat(url.surt_of(F.col("url")), F.lit(".münchen"))).alias("name"), url.robots_host_of(odd).alias("authority"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.host_edges(links.captures(cross_wats(spark, sf_dir)))


@query("edge_tables", f"with {CROSS} select s, t from cross_ union select t, s from cross_")
def _(spark, sf_dir):
    """Edges of several saved tables, each once."""
    one, other = shared.folder(spark, "edges"), shared.folder(spark, "edges")
    _edges(spark, sf_dir).write.parquet(one)
    spark.read.parquet(one).select(F.col("t").alias("s"), F.col("s").alias("t")).write.parquet(other)
    return tables.edges(spark, one, other)


@query("edge_sink", f"with {CROSS} select s, t, true as ordered from cross_")
def _(spark, sf_dir):
    """A table of sorted edges, read again: whether each is behind the one before in its file."""
    name = f"edges_{uuid.uuid4().hex}"
    edges = _edges(spark, sf_dir)
    sinks.edges(edges.unionByName(edges), name, 2, format="orc", path=shared.folder(spark, name), maxRecordsPerFile="1000000")
    at = Window.partitionBy("file").orderBy("row")
    rows = spark.table(name).select("s", "t", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    return rows.select("s", "t", F.coalesce(F.struct("s", "t") > F.lag(F.struct("s", "t")).over(at), F.lit(True)).alias("ordered"))


@query("tsv_sink", f"with {CROSS}, {NAMES} select cast(id as varchar) as s, name as t from ids")
def _(spark, sf_dir):
    """Gzip lines of vertices, read again."""
    folder = shared.folder(spark, "lines")
    sinks.tsv(graph.vertices(_edges(spark, sf_dir)), folder, "id", "name")
    return tables.tsv_edges(spark, folder)


@query("index_export_count", "select count(*) as n, count(distinct url) as urls from pages where url like 'https:%'")
def _(spark, sf_dir):
    name = f"export_{uuid.uuid4().hex}"
    rows = index.query(spark, f"{sf_dir}/pages.parquet", "SELECT page_id, url FROM ccindex WHERE url LIKE 'https:%'")
    n = index.export(rows, name, 2, path=shared.folder(spark, name))
    return spark.table(name).agg(F.lit(n).cast("long").alias("n"), F.countDistinct("url").alias("urls"))


@query("file_scan", "select cast(count(*) as bigint) as n from pages")
def _(spark, sf_dir):
    """Checksums of files that are scanned, against those of their contents."""
    folder = shared.folder(spark, "files").removeprefix("file://")

    def write(batches):
        for b in batches:
            for i, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist()):
                sinks.put_file(folder, f"{i}.html", (html or "").encode())
            yield b.select(["page_id"])

    pages = table(spark, sf_dir, "pages")
    pages.select("page_id", "html").mapInArrow(write, "page_id long").agg(F.count("*")).collect()
    found = files.md5(tables.files(spark, f"file://{folder}")).select(F.regexp_extract("uri", "([0-9]+)[.]html$", 1).cast("long").alias("page_id"), F.col("md5").alias("found"))
    return pages.join(found, "page_id").filter(F.md5(F.encode(F.coalesce("html", F.lit("")), "UTF-8")) == F.col("found")).agg(F.count("*").alias("n"))


@query("sql_arrays_and_maps", "select p_partkey, cast(len(string_split(p_name, ' ')) as bigint) as n, list_contains(string_split(p_type, ' '), 'STEEL') as steel, p_size as size_in_map from part")
def _(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, CAST(size(split(p_name, ' ')) AS BIGINT) AS n, array_contains(split(p_type, ' '), 'STEEL') AS steel, map('brand', -1, 'size', p_size)['size'] AS size_in_map FROM part")


for _name, _sql in passthrough.SQL.items():
    QUERIES[_name], ORACLES[_name] = passthrough.run(_sql), _sql
