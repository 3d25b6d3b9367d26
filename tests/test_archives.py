import gzip
import io
import os

import pytest
from pyspark.sql import functions as F

from weftarc import jobs, sinks
from weftarc.operators import index, wet
from weftarc.sources import archives, tables
from weftarc.sources.warcfile import Writer, records

HTML = b"HTTP/1.1 200 OK\r\nServer: s\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


@pytest.fixture(scope="module")
def crawl(tmp_path_factory):
    folder = tmp_path_factory.mktemp("crawl")
    places = []
    for k in range(3):
        with open(folder / f"{k}.warc.gz", "wb") as f:
            w = Writer(f)
            w.write("warcinfo", b"operator: me\r\nhostname: h\r\n", "application/warc-fields")
            for i in range(5):
                url = f"http://h{k}.com/{i}"
                w.write("request", b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request", url, "2024-01-01T00:00:00Z")
                body = HTML + f"<p>page {i}</p><script>x</script>".encode() if i else b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"
                places.append((url, f"{k}.warc.gz", *w.write("response", body, "application/http; msgtype=response", url, "2024-01-01T00:00:00Z")))
                w.write("metadata", b'charset-detected: UTF-8\r\nlanguages-cld2: {"languages":[{"code-iso-639-3":"eng"},{"code-iso-639-3":"fra"}]}\r\n', "application/warc-fields", url, "2024-01-01T00:00:00Z")
    return folder, places


def test_scan(spark, crawl):
    folder, places = crawl
    df = archives.read(spark, str(folder))
    assert df.count() == 48 and df.filter("rec_type = 'response'").count() == 15 and df.filter("error IS NOT NULL").count() == 0
    one = df.filter("headers['warc-target-uri'] = 'http://h1.com/2' AND rec_type = 'response'").first()
    assert bytes(one.payload) == b"<p>page 2</p><script>x</script>" and one.http_status_line == "HTTP/1.1 200 OK" and one.http_headers[0].value == "s"
    assert (one.offset, one.length) == next(p[2:] for p in places if p[0] == "http://h1.com/2")
    assert archives.from_hadoop(spark, str(folder)).count() == 48
    only = archives.read(spark, str(folder), recordtypes="warcinfo,metadata", payload="false")
    assert only.count() == 18 and only.filter("payload IS NOT NULL").count() == 0


def test_types_are_pushed_down(spark, crawl):
    df = archives.read(spark, str(crawl[0])).filter(F.col("rec_type").isin("response", "request"))
    assert df.count() == 30
    reader = archives.Reader({"path": str(crawl[0])})
    assert list(reader.pushFilters([archives.EqualTo(("rec_type",), "response"), archives.EqualTo(("warc_uri",), "x")])) == [archives.EqualTo(("warc_uri",), "x")]
    assert reader.types == {"response"}


def test_manifest_and_base(spark, crawl, tmp_path):
    (tmp_path / "list.gz").write_bytes(gzip.compress(b"0.warc.gz\n\n2.warc.gz\n"))
    assert archives.read(spark, manifest=str(tmp_path / "list.gz"), base=f"{crawl[0]}/").count() == 32
    assert archives.manifest(spark, str(tmp_path / "list.gz"), 2).count() == 2


@pytest.mark.parametrize("hadoop", [False, True])
def test_fetch(spark, crawl, hadoop):
    folder, places = crawl
    rows = spark.createDataFrame([(*p, "utf-8") for p in places[::4]] + ([] if hadoop else [("u", "missing.warc.gz", 0, 10, None)]), "url string, warc_filename string, warc_record_offset long, warc_record_length long, content_charset string")
    got = {r.url: r for r in index.records(rows, f"{folder}/", 2, hadoop=hadoop).collect()}
    assert all(got[p[0]].headers["warc-target-uri"] == p[0] and got[p[0]].headers["warc-identified-content-charset"] == "utf-8" for p in places[::4])
    assert hadoop or (got["u"].error and got["u"].rec_type is None)


def test_damage(spark, crawl, tmp_path):
    whole = (crawl[0] / "0.warc.gz").read_bytes()
    (tmp_path / "cut.warc.gz").write_bytes(whole[:-20])
    (tmp_path / "junk.warc").write_bytes(b"hello\nworld")
    got = archives.read(spark, str(tmp_path)).collect()
    assert sum(r.error is None for r in got) == 15 and sum(r.error is not None for r in got) == 2
    with pytest.raises(Exception):
        archives.read(spark, str(tmp_path), mode="FAILFAST").count()


def test_plain_arc_and_encodings():
    arc = b"filedesc://x 0.0.0.0 20240101000000 text/plain 3\n1 0\n\nhttp://a/ 1.2.3.4 20240101000000 text/html 46\nHTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhi\n"
    a, b = records(io.BytesIO(arc))
    assert a.rec_type == "warcinfo" and (b.rec_type, b.headers["warc-ip-address"], b.payload) == ("response", "1.2.3.4", b"hi")
    body = gzip.compress(b"text")
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nX: 1\r\n  2\r\n\r\n" + b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n"
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    first, second = records(io.BytesIO(plain * 2))
    assert first.payload == b"text" and first.http[2] == ("X", "1 2") and second.offset == len(plain)
    (raw,) = records(io.BytesIO(plain), decode=False)
    assert raw.payload.startswith(b"%x" % len(body))
    assert list(records(io.BytesIO(b""))) == []


def test_wet(spark, crawl, tmp_path):
    folder, _ = crawl
    names = spark.createDataFrame([(f"{k}.warc.gz",) for k in range(3)] + [("no.warc.gz",)], "uri string")
    for _ in range(2):  # a second run gives the same
        got = wet.extract(names, str(tmp_path), f"{folder}/").collect()
        assert sum(r.error is None for r in got) == 12 and sum(r.error is not None for r in got) == 1
    assert sorted(os.listdir(tmp_path)) == [f"{k}.warc.wet.gz" for k in range(3)]
    r = next(r for r in got if r.uri == "http://h2.com/3")
    place = r.wet_record_location
    with open(tmp_path / place.filename, "rb") as f:
        f.seek(place.offset)
        (rec,) = records(io.BytesIO(f.read(place.length)))
    assert rec.payload == b"page 3" and rec.rec_type == "conversion" and rec.headers["warc-identified-content-language"] == "eng,fra" and rec.headers["warc-refers-to"]
    with open(tmp_path / "0.warc.wet.gz", "rb") as f:
        info = next(records(f))
    assert info.rec_type == "warcinfo" and b"operator: me" in info.payload and b"hostname" not in info.payload


@pytest.mark.parametrize("order", ["rmrm", "mrmr", "rrm", "rmmr"])
def test_wet_of_captures_with_one_url_and_date(order):
    source, seen = io.BytesIO(), {"r": 0, "m": 0}
    w = Writer(source)
    for kind in order:
        n = seen[kind] = seen[kind] + 1
        about = ("application/http; msgtype=response", HTML + f"<p>page {n}</p>".encode()) if kind == "r" else ("application/warc-fields", f'languages-cld2: {{"languages":[{{"code-iso-639-3":"l{n}"}}]}}\r\n'.encode())
        w.write({"r": "response", "m": "metadata"}[kind], about[1], about[0], "http://h/", "2024-01-01T00:00:00Z")
    out = io.BytesIO()
    assert len(list(wet.convert("0.warc.gz", io.BytesIO(source.getvalue()), out))) == 2
    found = [(r.payload, r.headers.get("warc-identified-content-language")) for r in records(io.BytesIO(out.getvalue())) if r.rec_type == "conversion"]
    assert found == list(zip([b"page 1", b"page 2"], {"rmrm": ["l1", "l2"], "mrmr": ["l1", "l2"], "rrm": [None, "l1"], "rmmr": ["l2", None]}[order]))


def test_tables_and_sinks(spark, tmp_path):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "b")], "s string, t string")
    sinks.edges(edges, "edges_of_test", 1, compression="snappy")
    assert [tuple(r) for r in spark.table("edges_of_test").collect()] == [("a", "b"), ("b", "a")]
    sinks.table(edges, "orc_of_test", 1, "orc")
    with pytest.raises(Exception):
        sinks.table(edges, "orc_of_test", 1, "orc")
    sinks.tsv(edges, f"{tmp_path}/tsv", "s", "t")
    assert tables.tsv_edges(spark, f"{tmp_path}/tsv").count() == 3
    edges.write.parquet(f"{tmp_path}/e")
    assert tables.edges(spark, f"{tmp_path}/e").count() == 3 and tables.edges(spark, f"{tmp_path}/e", f"{tmp_path}/e").count() == 2
    assert sinks.put_file(str(tmp_path / "out"), "x", b"1") and sinks.has_file(str(tmp_path / "out"), "x")
    with pytest.raises(ValueError):
        sinks.put_file("http://h/", "x", b"")
    with pytest.raises(NotImplementedError):
        sinks.put_file("hdfs://h/", "x", b"")


def test_index(spark, tmp_path):
    rows = spark.createDataFrame([("u", "f", 1, 2), ("v", "f", 3, 4)], "url string, warc_filename string, warc_record_offset long, warc_record_length long")
    rows.write.parquet(f"{tmp_path}/i")
    rows.write.csv(f"{tmp_path}/c", header=True)
    got = index.query(spark, f"{tmp_path}/i", "SELECT url FROM ccindex WHERE warc_record_offset > 1", schema=rows.schema.json())
    assert [r.url for r in got.collect()] == ["v"] and index.export(got, "export_of_test", 1) == 1
    assert tables.coordinates(spark, f"{tmp_path}/c", csv=True).count() == 2 and tables.coordinates(spark, f"{tmp_path}/i", "parquet").count() == 2
    for bad in ({}, {"csv": True, "format": "orc"}):
        with pytest.raises(ValueError):
            tables.coordinates(spark, "x", **bad)


def test_jobs(spark, crawl, tmp_path):
    (tmp_path / "list").write_text("".join(f"{k}.warc.gz\n" for k in range(3)))
    common = [str(tmp_path / "list")]
    base = ["--input_base_url", f"{crawl[0]}/", "--num_output_partitions", "1"]
    seen = jobs.run(["server_count", *common, "job_servers", *base], spark)
    assert {r.key: r.val for r in spark.table("job_servers").collect()} == {"s": 12, "(no server in HTTP header)": 3} and seen["warc_input_failed"] == 0
    jobs.run(["host_links", *common, "job_links", *base, "--output_option", "maxRecordsPerFile=1"], spark)
    assert spark.table("job_links").count() == 3
    edges = str(tmp_path / "edges")
    spark.table("job_links").write.parquet(edges)
    jobs.run(["host_graph", edges, "job_graph", "--save_as_text", str(tmp_path / "text"), "--validate_host_names"], spark)
    assert [r.id for r in spark.table("job_graph_vertices").orderBy("name").collect()] == [0, 1, 2] and os.path.isdir(tmp_path / "text" / "vertices")
    jobs.run(["md5", str(crawl[0]), "job_md5"], spark)
    assert spark.table("job_md5").count() == 3
    assert set(jobs.JOBS) >= {"server_count", "server_ip", "tag_count", "word_count", "sitemaps", "page_links", "host_links", "host_graph", "link_map", "md5", "wet", "index_export", "index_word_count"}


def test_catalogue(spark):
    """Each query against its SQL."""
    duckdb = pytest.importorskip("duckdb")
    from weftarc.plans import catalog, passthrough

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in passthrough.TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    value = lambda x: None if x is None else f"{float(x):.5f}" if isinstance(x, float) or hasattr(x, "as_tuple") and not isinstance(x, tuple) else str(x)
    for name, sql in catalog.ORACLES.items():
        df = catalog.QUERIES[name](spark, folder)
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns), name
        columns = sorted(df.columns)
        ours = sorted(repr([value(r[c]) for c in columns]) for r in df.collect())
        theirs = sorted(repr([value(dict(zip(want.columns, r))[c]) for c in columns]) for r in want.fetchall())
        assert ours == theirs, name


@pytest.fixture(scope="module")
def store(spark, crawl):
    """The crawl by a path that only Spark opens."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.crawl.link./in", f"file://{crawl[0]}")
    return "viewfs://crawl/in/"


def test_listing_in_a_store(spark, crawl, store, tmp_path):
    """A listing, itself in a store, of files in a store and of local ones."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lists.link./in", f"file://{tmp_path}")
    (tmp_path / "list").write_text(f"0.warc.gz\n{crawl[0]}/1.warc.gz\nfile://{crawl[0]}/2.warc.gz\n")
    (tmp_path / "far").write_text("0.warc.gz\n1.warc.gz\n")
    assert archives.listed(spark, str(tmp_path / "far"), store, 2).count() == 32
    got = archives.listed(spark, "viewfs://lists/in/far", store, 2, ["response"])
    assert got.count() == 10 and got.filter("error IS NOT NULL").count() == 0
    (tmp_path / "mixed").write_text(f"{store}0.warc.gz\nfile://{crawl[0]}/1.warc.gz\n{crawl[0]}/2.warc.gz\n")
    assert archives.listed(spark, str(tmp_path / "mixed"), None, 2).count() == 48
    base = ["--input_base_url", store, "--num_output_partitions", "1"]
    seen = jobs.run(["server_count", str(tmp_path / "far"), "far_servers", *base], spark)
    assert {r.key: r.val for r in spark.table("far_servers").collect()} == {"s": 8, "(no server in HTTP header)": 2} and seen["warc_input_processed"] == 2


def test_fetch_from_a_store(spark, crawl, store):
    rows = spark.createDataFrame(crawl[1], "url string, warc_filename string, warc_record_offset long, warc_record_length long")
    found = index.records(rows, store, 2)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.url: r for r in found.collect()}
    assert len(got) == 15 and all(got[p[0]].headers["warc-target-uri"] == p[0] and got[p[0]].error is None for p in crawl[1])


def test_object_stores(crawl, monkeypatch):
    """Whole files and parts through an Arrow file system."""
    from pyarrow import fs

    from weftarc.sources import uri

    asked = []
    monkeypatch.setattr(uri, "store", lambda place: (asked.append(place), (fs.LocalFileSystem(), str(crawl[0] / place.path)))[1])
    url, name, offset, length = crawl[1][7]
    with uri.open_range(name, "s3a://bucket/", offset, length) as f:
        (r,) = records(f)
    assert r.headers["warc-target-uri"] == url and asked[0].authority == "bucket"
    with uri.open_range(f"gs://bucket/{name}") as f:
        assert sum(1 for _ in records(f)) == 16


def test_web(crawl):
    import functools
    import http.server
    import threading

    from weftarc.sources import uri

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(crawl[0])))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with uri.open_range("1.warc.gz", f"http://127.0.0.1:{server.server_port}/") as f:
            assert sum(1 for _ in records(f)) == 16
    finally:
        server.shutdown()


def test_wet_skips_what_exists(spark, crawl, tmp_path):
    (tmp_path / "list").write_text("0.warc.gz\n1.warc.gz\n")
    options = ["--input_base_url", f"{crawl[0]}/", "--output_base_url", str(tmp_path / "wet"), "--num_output_partitions", "1", "--local_temp_dir", str(tmp_path)]
    seen = jobs.run(["wet", str(tmp_path / "list"), "wet_first", *options], spark)
    assert seen == {"wet_records_written": 8, "warc_input_failed": 0, "warc_input_skip_output_exists": 0, "warc_input_processed": 2}
    before = (tmp_path / "wet" / "0.warc.wet.gz").read_bytes()
    (tmp_path / "list").write_text("0.warc.gz\n2.warc.gz\nno.warc.gz\n")
    seen = jobs.run(["wet", str(tmp_path / "list"), "wet_second", *options], spark)
    assert seen == {"wet_records_written": 4, "warc_input_failed": 1, "warc_input_skip_output_exists": 1, "warc_input_processed": 1}
    assert (tmp_path / "wet" / "0.warc.wet.gz").read_bytes() == before
    jobs.run(["wet", str(tmp_path / "list"), "wet_third", *options, "--overwrite"], spark)
    assert spark.table("wet_third").filter("error IS NULL").count() == 8


def test_counters_of_jobs(spark, crawl, tmp_path):
    folder = tmp_path / "robotstxt"
    folder.mkdir()
    with open(folder / "0.warc.gz", "wb") as f:
        w = Writer(f)
        w.write("response", b"HTTP/1.1 200 OK\r\n\r\nSitemap: http://a.com/s.xml\nSitemap: /\xff\n", "application/http; msgtype=response", "http://a.com/robots.txt", "2024-01-01T00:00:00Z")
    (tmp_path / "list").write_text(f"{folder}/0.warc.gz\n{folder}/none.warc.gz\n")
    seen = jobs.run(["sitemaps", str(tmp_path / "list"), "counted_sitemaps", "--num_output_partitions", "1"], spark)
    want = {"robots_txt_processed": 1, "sitemap_urls_found": 2, "sitemap_url_invalid_encoding": 1, "robots_txt_announcing_sitemap": 1, "robots_txt_with_more_than_50_sitemaps": 0}
    want |= {"warc_input_processed": 1, "warc_input_failed": 1, "records_response": 1, "records_response_robotstxt": 1}
    assert {k: seen[k] for k in want} == want
    seen = jobs.run(["page_links", str(tmp_path / "list"), "counted_links", "--intermediate_output", "counted_between", "--num_output_partitions", "1"], spark)
    assert seen["link_count"] == 1 and spark.table("counted_between").count() == spark.table("counted_links").count() == 1
    again = jobs.run(["page_links", "", "counted_links_again", "--intermediate_output", "counted_between", "--num_output_partitions", "1"], spark)
    assert again == {} and spark.table("counted_links_again").count() == 1
    places = str(tmp_path / "places")
    spark.createDataFrame([*crawl[1], ("u", "none.gz", 0, 5)], "url string, warc_filename string, warc_record_offset long, warc_record_length long").write.csv(places, header=True)
    seen = jobs.run(["index_word_count", places, "counted_words", "--csv", "--input_base_url", f"{crawl[0]}/", "--num_output_partitions", "1"], spark)
    assert (seen["records_processed"], seen["records_failed"], seen["records_parse_success"], seen["records_parse_failed"]) == (15, 1, 12, 0)


def test_side_files_in_an_object_store(tmp_path, monkeypatch):
    from pyarrow import fs

    from weftarc.sources import uri

    monkeypatch.setattr(uri, "store", lambda place: (fs.LocalFileSystem(), str(tmp_path / place.path.replace("/", "_"))))
    assert not sinks.has_file("s3://bucket/out/", "a.gz")
    assert sinks.put_file("s3://bucket/out/", "a.gz", b"raw") == "s3://bucket/out/a.gz" and sinks.has_file("s3a://bucket/out", "a.gz")
    assert (tmp_path / "out_a.gz").read_bytes() == b"raw"
