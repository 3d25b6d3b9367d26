import json

import pytest
from pyspark.sql import functions as F

from weftarc import records as R
from weftarc.operators import counts, files, graph, links, sitemaps

ROW = "warc_uri string, rec_type string, content_type string, headers map<string,string>, http_status_line string, http_headers array<struct<name:string,value:string>>, payload binary, offset long, length long, error string"


def record(kind="response", uri="http://H.com/", http=(), payload=b"", status="HTTP/1.1 200 OK", file="f", content_type="application/http", **headers):
    named = {"warc-target-uri": uri} | {k.replace("_", "-"): v for k, v in headers.items()}
    return (file, kind, content_type, {k: v for k, v in named.items() if v is not None}, status, [tuple(h) for h in http], payload, 0, 0, None)


def wat(meta, **response):
    body = {"Envelope": {"WARC-Header-Metadata": meta, "Payload-Metadata": {"HTTP-Response-Metadata": response}}}
    return record("metadata", meta.get("WARC-Target-URI"), payload=json.dumps(body).encode(), content_type="application/json", status=None)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_predicates(spark):
    rows = table(
        spark, record("warcinfo", content_type="application/warc-fields"), record(), record("metadata", content_type="application/warc-fields"), record("conversion", content_type="text/plain"),
        record("metadata", content_type="application/json"), record("conversion", content_type="text/plain; charset=utf-8"), record(None, content_type=None),
    )
    got = rows.select(R.is_warcinfo(), R.is_response(), R.is_metadata(), R.is_wet_text(), R.is_wat_json()).collect()
    assert [list(r).index(True) if True in list(r) else None for r in got] == [0, 1, 2, 3, 4, None, None]


def test_is_html(spark):
    kind = lambda v: [("Content-Type", v)]
    rows = table(
        spark, record(http=kind("text/html")), record(http=kind("TEXT/HTML; charset=x")), record(http=kind("application/pdf")), record(http=kind("text/html"), warc_identified_payload_type="application/pdf"),
        record(warc_identified_payload_type="application/xhtml+xml"), record(), record(warc_identified_payload_type="text/html; x"),
    )
    assert [r[0] for r in rows.select(R.is_html()).collect()] == [True, True, False, True, True, False, False]


def test_status(spark):
    lines = ["HTTP/1.1 301 Moved", "HTTP / 1.0 308", "HTTP/1.1 200 OK", "HTTP/2 301", "HTTP/1.1 3011", None]
    got = table(spark, *(record(status=s) for s in lines)).select(R.is_redirect(), R.is_success()).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, False), (False, True), (False, False), (False, False), (False, False)]


@pytest.mark.parametrize(
    "rows,want",
    [
        ([record(http=[("Server", "a"), ("server", "b"), ("Server", "a")])], [("a", 1), ("b", 1)]), ([record(http=[("Server", "")])], [(R.NO_SERVER, 1)]), ([record()], [(R.NO_SERVER, 1)]),
        ([wat({}, Headers={"Server": ["a", "a "]})], [("a", 2)]), ([wat({}, Headers={"Server": ""})], []), ([wat({})], [(R.NO_SERVER, 1)]), ([wat({}, Headers={"X": "y"})], [(R.NO_SERVER, 1)]), ([record("request")], []),
        ([wat({}, Headers={"Server": "a", "server": "b"})], [("a", 1), ("b", 1)]),
    ],
)
def test_servers(spark, rows, want):
    assert pairs(counts.server_count(table(spark, *rows))) == want


@pytest.mark.parametrize(
    "row,want",
    [
        (record(), [("h.com", R.NO_IP, 1)]), (record(uri="mailto:x", warc_ip_address="1.2.3.4"), [(None, "1.2.3.4", 1)]), (record(uri=None, warc_ip_address="1.2.3.4"), [(R.NO_HOST, "1.2.3.4", 1)]),
        (record(uri="http://[malformed::url]/"), [(R.NO_HOST, R.NO_IP, 1)]), (wat({"WARC-Type": "response", "WARC-Target-URI": "http://a.b/"}), []),
        (wat({"WARC-Type": "response", "WARC-Target-URI": "http://a.b:8/", "WARC-IP-Address": "::1"}), [("a.b", "::1", 1)]), (wat({"WARC-Type": "request", "WARC-IP-Address": "::1"}), []), (wat({}), [(R.NO_HOST, R.NO_IP, 1)]),
    ],
)
def test_addresses(spark, row, want):
    assert [tuple(r) for r in counts.server_ip_count(table(spark, row)).collect()] == want


def test_words(spark):
    rows = table(spark, *(record("conversion", content_type="text/plain", payload=t.encode()) for t in ("A a b_1", "b_1", "")))
    assert pairs(counts.word_count(rows)) == [("a", 2, 1), ("b_1", 2, 2)]
    page = record(http=[("content-type", "text/html")], payload=b"<p>A a</p><script>no</script>b")
    assert pairs(counts.html_word_count(table(spark, page))) == [("a", 2, 1), ("b", 1, 1)]
    assert pairs(counts.tag_count(table(spark, page, record(payload=b"<p>")))) == [("p", 1), ("script", 1)]


def robots(body, uri="http://example.com/robots.txt"):
    return record(uri=uri, payload=body)


COUNTERS = ["robots_txt_processed", "sitemap_urls_found", "sitemap_url_invalid_encoding", "robots_txt_announcing_sitemap", "robots_txt_with_more_than_50_sitemaps"]
SITE = "http://example.com/sitemap.xml"


@pytest.mark.parametrize(
    "rows,want,counted",
    [
        ([robots(b"User-agent: *\nDisallow: /search\n\nSitemap: http://other.org/sitemap.xml\n", "http://a.b.com.ar/robots.txt")], [("http://other.org/sitemap.xml", ["a.b.com.ar"])], (1, 1, 0, 1, 0)),
        ([robots(b"User-agent: *\n" * 150 + b"Sitemap: http://3.ru/s.xml", "http://1.2.3.ru/robots.txt")], [("http://3.ru/s.xml", ["1.2.3.ru"])], (1, 1, 0, 1, 0)),
        ([robots(f"Sitemap: {SITE}".encode(), f"http://h{i}.com/robots.txt") for i in range(3)], [(SITE, ["h0.com", "h1.com", "h2.com"])], (3, 3, 0, 3, 0)),
        ([robots(f"Sitemap: {SITE}".encode("utf-16"))], [], (1, 0, 0, 0, 0)),
        ([robots(b"Sitemap: http://e.com/1\nSitemap: http://e.com/2", "http://[malformed::url]/robots.txt")], [], (1, 1, 0, 0, 0)),
        ([robots(f"sitemap:{SITE}".encode(), "http://xn--foo/robots.txt")], [(SITE, ["xn--foo"])], (1, 1, 0, 1, 0)),
        ([robots(b"Sitemap: http://e.com/\xe9.xml")], [], (1, 1, 1, 0, 0)),
        ([robots(b"Sitemap: http://e.com/1\r\n Sitemap: \xff\xfe\r\nSITEMAP: /2 trailing")], [("http://e.com/1", ["example.com"]), ("http://example.com/2", ["example.com"])], (1, 3, 1, 1, 0)),
        ([robots(b"Sitemap: ht!tp://[malformed::url]/sitemap.xml")], None, (1, 1, 0, 1, 0)),
        ([robots(b"".join(b"Sitemap: http://e.com/%d\n" % i for i in range(60)))], None, (1, 60, 0, 1, 1)),
        ([robots(b"Sitemap: http://e.com/1", "http://User@.H.com:8/robots.txt")], [("http://e.com/1", ["user@.h.com:8"])], (1, 1, 0, 1, 0)),
        ([record("request", payload=b"Sitemap: http://e.com/1")], [], (0, 0, 0, 0, 0)),
        ([robots(f"Sitemap: {SITE}\nSitemap: {SITE}".encode())], [(SITE, ["example.com", "example.com"])], (1, 2, 0, 1, 0)),
    ],
)
def test_sitemaps(spark, rows, want, counted):
    got = pairs(sitemaps.sitemaps(table(spark, *rows)))
    assert got == want if want is not None else len(got) == counted[1]
    c = sitemaps.counters(table(spark, *rows)).first()
    assert tuple(c[k] for k in COUNTERS) == counted


META = {"WARC-Type": "response", "WARC-Target-URI": "http://www.a.com/x/p.html"}
EXAMPLE = wat(
    META, Headers={"Link": "<https://b.org/s.css>; rel=preload, </c>; rel=x", "Content-Location": "/p"},
    **{"HTML-Metadata": {
        "Head": {"Base": "http://base.net/d/", "Link": [{"url": "style.css"}], "Metas": [{"property": "og:url", "content": "https://www.a.com/x"}, {"name": "twitter:image"}, {"name": "keywords", "content": "foo"}, {"content": "//cdn.org/i.png"}], "Scripts": []},
        "Links": [{"url": "q.html"}, {"href": "https://d.com/"}, {"href": "rel.html"}, {"url": "http://www.a.com/z"}]}},
)


def test_page_links(spark):
    got = links.page_links(table(spark, EXAMPLE)).collect()
    assert {r.s for r in got} == {META["WARC-Target-URI"]}
    assert {r.t for r in got} == {"https://b.org/s.css", "/c", "/p", "http://base.net/d/style.css", "https://www.a.com/x", META["WARC-Target-URI"], "http://cdn.org/i.png", "http://base.net/d/q.html", "https://d.com/", "http://www.a.com/z"}
    assert len(got) == 10


def test_host_links(spark):
    assert pairs(links.host_links(table(spark, EXAMPLE))) == [("com.a", "com.d"), ("com.a", "net.base"), ("com.a", "org.b"), ("com.a", "org.cdn")]


MOVED = {"status": "HTTP/1.1 302 Found", "http": [("Location", "/login x")], "uri": "http://a.com/1"}


@pytest.mark.parametrize(
    "row,pages,hosts",
    [
        (wat(META), [(META["WARC-Target-URI"],) * 2], [("com.a", "com.a")]), (record(**MOVED), [("http://a.com/1", "/login")], [("com.a", "com.a")]), (record(uri="http://a.com/2"), [("http://a.com/2",) * 2], [("com.a", "com.a")]),
        (wat(META | {"WARC-Type": "request"}), [], []), (record("metadata", payload=b"{no json", content_type="application/json"), [], []),
        (record(uri="http://a.com/robots.txt", file="s3://c/robotstxt/1", payload=b"Sitemap: http://b.org/s\nSitemap: /r\nSitemap: http://a.com/t"), [("http://a.com/robots.txt",) * 2], [("com.a", "org.b")]),
        (record(**MOVED | {"http": [("location", "https://www.a.com/")]}), [("http://a.com/1", "https://www.a.com/")], [("com.a", "com.a")]), (record("request"), [], []),
        (wat(META | {"WARC-Target-URI": "http://localhost/"}, **{"HTML-Metadata": {"Head": {"Base": "http://b.net/"}, "Links": [{"url": "x"}, {"url": "//c.org/"}]}}), [("http://localhost/", "http://b.net/x"), ("http://localhost/", "http://c.org/")], [("net.b", "org.c")]),
    ],
)
def test_other_links(spark, row, pages, hosts):
    assert pairs(links.page_links(table(spark, row))) == pages
    assert pairs(links.host_links(table(spark, row))) == hosts


def test_graph(spark):
    edges = spark.createDataFrame([("com.a", "com.a"), ("com.a", "org.b"), ("de.münchen", "org.b"), ("org.b", "localhost"), ("nosuch.c", "com.a")], "s string, t string")
    ids = {r.name: r.id for r in graph.vertices(edges, normalize=True, validate=True).collect()}
    assert ids == {"com.a": 0, "de.xn--mnchen-3ya": 1, "org.b": 2}
    made = graph.vertices(edges, normalize=True, validate=True)
    assert pairs(graph.edges_of_ids(edges, made)) == [(0, 2)] and pairs(graph.edges_of_ids(edges, made, normalize=True)) == [(0, 2), (1, 2)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_ids_are_dense_and_in_order(spark, partitions):
    names = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("name"))
    got = graph.with_ids(names, partitions).orderBy("id").collect()
    assert [r.id for r in got] == list(range(5000)) and [r.name for r in got] == sorted(r.name for r in got)


def test_saved_ids(spark):
    edges = spark.createDataFrame([("com.a", "org.b")], "s string, t string")
    first = pairs(graph.load_or_make_ids(edges, "ids_of_test"))
    assert first == pairs(graph.load_or_make_ids(edges.limit(0), "ids_of_test")) == [("com.a", 0), ("org.b", 1)]


def test_md5(spark):
    rows = spark.createDataFrame([("f", b"x"), ("f", b"x"), ("g", b"")], "path string, content binary")
    assert pairs(files.md5(rows)) == [("f", "9dd4e461268c8034f5c8564e155c67a6"), ("g", "d41d8cd98f00b204e9800998ecf8427e")]


def test_host_links_of_captures_of_one_url(spark):
    """A capture without links is an edge to itself, though another capture of its URL has links."""
    with_link = wat(META, **{"HTML-Metadata": {"Links": [{"url": "https://d.com/"}]}})
    assert pairs(links.host_links(table(spark, with_link, wat(META), with_link))) == [("com.a", "com.a"), ("com.a", "com.d")]


def test_host_links_beyond_plain_names(spark):
    odd = wat(META, **{"HTML-Metadata": {"Links": [{"url": "https://bücher.de/"}, {"url": "//USER@x.org:8/"}, {"url": "http://10.0.0.1/"}, {"url": "ftp://www.f.net/"}]}})
    assert pairs(links.host_links(table(spark, odd))) == [("com.a", "de.xn--bcher-kva"), ("com.a", "net.f"), ("com.a", "org.x")]


def test_host_links_scan_once(spark):
    plan = links.host_links(table(spark, EXAMPLE))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
