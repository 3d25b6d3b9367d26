"""Queries of the catalogue against their SQL, on pages made for what the test tables hold rarely or not at all."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from weftarc.plans import catalog

#: Character references with their semicolon, and at the end of a heading cut short.
CUT = ["<p>one &amp; two</p>", "<h1>Ly.&amp;&amp; and&amp</h1><p>x&copy y &copyx z</p>", "<p>and</p>", "<h2>&amp;&amp</h2>and&amp", "<p title='a&ampb'>q&lt<b>r</b> &nosuch s</p>"]


def both(spark, folder, name, htmls, urls=None):
    """Sorted rows of a query and of its SQL."""
    urls = urls or [f"http://h{i}.example.com/" for i in range(len(htmls))]
    pq.write_table(pa.table({"page_id": pa.array(range(len(htmls)), pa.int64()), "url": urls, "html": htmls}), f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    return sorted(map(tuple, catalog.QUERIES[name](spark, str(folder)).collect())), sorted(con.execute(catalog.ORACLES[name]).fetchall())


def test_html_word_count_of_cut_references(spark, tmp_path):
    got, want = both(spark, tmp_path, "html_word_count", CUT)
    assert got == want and ("amp", 3, 2) in got


def test_html_charsets_of_cut_references(spark, tmp_path):
    got, want = both(spark, tmp_path, "html_charsets", [h.replace("z", f"z{i}") for h in CUT for i in range(6)])
    assert got == want and any(w == "amp" for w, _, _ in got)


def test_index_word_count_of_cut_references(spark, tmp_path):
    got, want = both(spark, tmp_path, "index_word_count", CUT)
    assert got == want and ("amp", 3, 2) in got


def test_wet_word_count_of_cut_references(spark, tmp_path):
    got, want = both(spark, tmp_path, "wet_word_count", CUT)
    assert got == want and ("amp", 3, 2) in got


def test_redirect_links_of_pages_with_one_url(spark, tmp_path):
    urls = [f"http://h{i % 5}.example.com/" for i in range(33)]
    got, want = both(spark, tmp_path, "redirect_links", ["<p>x</p>"] * 33, urls)
    assert got == want and sum(t.startswith("/login") for _, t in got) == 3


#: Pages on which parsing failed, so that their words, or those of their whole archive, were lost.
ODD = ["<p>one <![foo]> two</p>", "<![foo[x]]><p>three</p>", f"<p>four &#{'1' * 5000}; five</p>", "<p>six</p>"]


def test_wet_word_count_of_pages_with_one_url(spark, tmp_path):
    pages = [f"<p>common w{i}</p>" for i in range(24)] + ["<figcaption>seven</figcaption>eight<address>nine</address>"]
    urls = ["http://h.example.com/"] * 12 + [None] * 12 + ["http://g.example.com/"]
    got, want = both(spark, tmp_path, "wet_word_count", pages, urls)
    assert got == want and ("common", 24, 24) in got and ("eight", 1, 1) in got


def test_wet_word_count_of_pages_that_do_not_parse(spark, tmp_path):
    got, want = both(spark, tmp_path, "wet_word_count", ODD)
    assert got == want and {"one", "two", "three", "four", "five", "six"} <= {w for w, _, _ in got}


def test_wet_extract_of_pages_with_one_url(spark, tmp_path):
    got, want = both(spark, tmp_path, "wet_extract", ["<p>x</p>"] * 12, ["http://h.example.com/"] * 12)
    assert got == want == [("http://h.example.com/", 12, True)]


def test_index_word_count_of_odd_urls(spark, tmp_path):
    ends = ["", "a,b", 'q"uo"te', '\\"', "back\\", "a\nb", "a\r\n\r\nb", '"', '",\n"', "# x", " y ", "é", "a\rb", "'"]
    urls = [f"http://h.example.com/{e}" for e in ends] + [None, "", "x\n\ny", '"', "\n"]
    got, want = both(spark, tmp_path, "index_word_count", [f"<p>common w{i}</p>" for i in range(len(urls))], urls)
    assert got == want and ("common", len(urls), len(urls)) in got


def test_index_word_count_of_pages_that_do_not_parse(spark, tmp_path):
    got, want = both(spark, tmp_path, "index_word_count", ODD)
    assert got == want and ("three", 1, 1) in got


#: Pages whose markup names an encoding that they are not in, or none of texts, and one that begins with a null.
CHARSETS = [f"<meta charset={c}><p>café {c}</p>" for c in ("iso-8859-1", "utf-16", "base64", "undefined", "idna", "utf-8")] + ["\0<p>été zéro</p>"]


@pytest.mark.parametrize("name", ["html_charsets", "index_word_count", "wet_word_count"])
def test_words_of_pages_that_name_other_charsets(spark, tmp_path, name):
    pages = [h.replace("é", f"é{i}é", 1) for h in CHARSETS for i in range(8)]  # in each of the encodings of html_charsets
    got, want = both(spark, tmp_path, name, pages)
    assert got == want and {"zéro", "base64", "idna"} <= {w for w, _, _ in got}


def test_html_charsets_of_pages_that_do_not_parse(spark, tmp_path):
    got, want = both(spark, tmp_path, "html_charsets", [h.replace("<p>", f"<p>n{i} ") for h in ODD for i in range(8)])
    assert got == want and any(w == "three" for w, _, _ in got)
