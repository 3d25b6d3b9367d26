import pytest
from pyspark.sql import functions as F

from weftarc.functions import html, text, tld, url
from weftarc.sources import uri as uris

HOSTS = [
    ("http://www.example.com/a", "com.example"), ("https://www.com/", "com.www"), ("http://www.www.example.com/", "com.example.www"), ("http://example.com.", "com.example"), ("http://example.com..", None),
    ("http://a..b.com/", None), ("http://localhost/", None), ("http://127.0.0.1/", None), ("http://www.10.0.0.1/x", None), ("http://User@Foo.ORG:81/x", "org.foo"), ("http://a_b.example.com/", "com.example.a_b"),
    ("http://_dmarc.example.com/", None), ("http://-a.com/", None), ("http://münchen.de/", "de.xn--mnchen-3ya"), ("http://ß.de/", "de.xn--zca"), ("//cdn.example.com/x", "com.example.cdn"), ("ftp://ftp.example.org/f", "org.example.ftp"),
    ("/rel/path", None), ("http:///abc/", None), ("mailto:a@example.com", None), ("http://[::1]/", None), ("http://[malformed::url]/", None), (f"http://{'a' * 64}.com/", None), ("http://example.com?q=1", "com.example"),
    ("HTTP://EXAMPLE.COM#x", "com.example"), ("http://x.y", "y.x"), (None, None), ("", None), ("http://a-.com/", None), ("http://1.2.3.x.com/", "com.x.3.2.1"),
]


@pytest.mark.parametrize("u,want", HOSTS)
def test_surt_host(u, want):
    assert url.surt_host(u) == want


def test_surt_host_column_equals_function(spark):
    rows = spark.createDataFrame([(u,) for u, _ in HOSTS], "u string")
    got = rows.select("u", url.surt_of(F.col("u")).alias("h"), url.surt_of(F.col("u"), True).alias("s"), url.host_of(F.col("u")).alias("host")).collect()
    for r in got:
        assert r.h == url.surt_host(r.u) and r.s in (None, r.h) and r.host == url.hostname(r.u)


def test_names(spark):
    rows = spark.createDataFrame([("de.münchen",), ("com.a",), ("com.-a",), (None,)], "n string")
    got = [tuple(r) for r in rows.select(url.normalized_of(F.col("n")).alias("a"), url.reversed_host(F.col("n")).alias("b")).collect()]
    assert got == [("de.xn--mnchen-3ya", "münchen.de"), ("com.a", "a.com"), (None, "-a.com"), (None, None)]


def test_words_and_tags(spark):
    markup = "<html><BODY><h1>x</h1><br/><a href=x><sVg></p><!-- <i> --><o:p>"
    r = spark.createDataFrame([("A a b_1 Été²", markup)], "t string, m string").select(text.words(F.col("t")).alias("w"), text.tag_names(F.col("m")).alias("g"), text.tag_names(F.col("m"), True).alias("i")).first()
    assert r.w == ["a", "a", "b_1", "été²"] and r.g == ["html", "h1", "br", "a", "s", "i", "o"] and "body" in r.i


def test_tld_rule_and_file(spark, tmp_path):
    (tmp_path / "tlds").write_text("# list\nCOM\nDe\n\n")
    assert sorted(r.tld for r in tld.table(spark, str(tmp_path / "tlds")).collect()) == ["com", "de"]
    r = spark.range(1).select(*(tld.by_rule(F.lit(x)).alias(x) for x in ("com", "de", "xn--p1ai", "nosuch"))).first()
    assert tuple(r) == (True, True, True, False) and len(tld.GENERIC) < 200


@pytest.mark.parametrize(
    "name,base,want",
    [
        ("s3://b/k/x", "p/", ("s3://b/k/x", "s3", "b", "k/x")), ("k/x", "s3a://b/", ("s3a://b/k/x", "s3a", "b", "k/x")), ("k/x", None, ("k/x", "", "", "k/x")), ("file:/a/b", None, ("file:/a/b", "file", "", "/a/b")),
        ("file:///a/b", None, ("file:///a/b", "file", "", "/a/b")), ("k/x", "/data/", ("/data/k/x", "", "", "/data/k/x")), ("https://h:1/p?q", None, ("https://h:1/p?q", "https", "h:1", "p?q")),
    ],
)
def test_resolve(name, base, want):
    assert tuple(uris.resolve(name, base)) == want


def test_html_text():
    page = b"<html><head><meta charset='iso-8859-1'><style>p{}</style></head><body><p>a\xe9 <b>b</b></p><script>x</script> c<div>d</div></body></html>"
    assert html.encoding_of(page) == "iso-8859-1" and html.to_text(page) == "aé b c d" and html.to_text(page, mode="layout") == "aé b\nc\nd"
    assert html.encoding_of(b"\xef\xbb\xbfx") == "utf-8-sig" and html.encoding_of(b"\xff") == "latin-1" and html.encoding_of(b"x", "nonsense") == "utf-8"
    assert html.encoding_of(b"x", None, "text/html; charset=koi8-r") == "koi8-r"


def test_html_references_end_in_a_semicolon():
    page = b"<h1>a&amp;&amp b&copy;</h1>caf&eacute; &copyx y&#233;&#xE9; &#233 &ampx; &notit; & z&lt"
    want = "a&&amp b© café &copyx yéé &#233 &ampx; &notit; & z&lt"
    assert html.to_text(page) == want and html.to_text(page, mode="layout") == want.replace("b© ", "b©\n")


def test_encodings_that_pages_name():
    wide = "\0été".encode("utf-16")
    assert html.encoding_of(wide) == "utf-16" and html.encoding_of("été".encode("utf-32")) == "utf-32"
    assert html.encoding_of(b"<meta charset=utf-16>x") == "utf-8" and html.encoding_of(b"<meta charset=base64>\xff", "idna", "text/html; charset=undefined") == "latin-1"
    assert html.to_text("<meta charset=iso-8859-1>é".encode(), content_type="text/html; charset=utf-8") == "é" != html.to_text("<meta charset=iso-8859-1>é".encode())
