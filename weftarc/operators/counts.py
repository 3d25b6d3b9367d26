"""Counts over archive records: servers, addresses, tags and words. One shuffle each, combined before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc import records as R
from weftarc.functions import html, text, url, wat


def _counted(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("val"))


def warc_servers() -> Column:
    """Of a response, its Server values, each once; the fallback if there is none that is not empty."""
    values = F.array_distinct(F.filter(R.http_values("server"), lambda v: v != ""))
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(R.NO_SERVER)))


def wat_servers(record: Column) -> Column:
    """Of a WAT record of a response, its Server values, trimmed and as often as they come; empty ones count as values but not as servers."""
    values = F.transform(wat.named(wat.headers(record), "server"), lambda v: F.btrim(v))
    found = F.when(F.size(values) > 0, F.filter(values, lambda v: v != "")).otherwise(F.array(F.lit(R.NO_SERVER)))
    return F.when(wat.has(record, *wat.RESPONSE), found)


def server_count(records: DataFrame) -> DataFrame:
    """(key, val) of server names, from response records and WAT records of responses."""
    names = F.when(R.is_wat_json(), wat_servers(wat.parsed(F.col("payload")))).when(R.is_response(), warc_servers())
    return _counted(records.filter(R.is_wat_json() | R.is_response()).select(F.explode(names).alias("key")))


def server_ip_count(records: DataFrame, simple_urls: bool = False) -> DataFrame:
    """(host, ip, cnt). A URL without a host has a null host; a missing one, or one that cannot be parsed, a sentinel."""
    chosen = records.filter(R.is_wat_json() | R.is_response()).withColumn("wat", F.when(R.is_wat_json(), wat.parsed(F.col("payload"))))
    meta = ("Envelope", "WARC-Header-Metadata")
    at = lambda name: wat.text_at(F.col("wat"), *meta, name)
    of_wat = R.is_wat_json()
    incomplete = of_wat & (~wat.has(F.col("wat"), *meta) | at("WARC-Type").isNull())
    dropped = of_wat & ~incomplete & ((at("WARC-Type") != "response") | at("WARC-IP-Address").isNull())
    rows = chosen.filter(~F.coalesce(dropped, F.lit(False))).select(
        F.when(of_wat & ~incomplete, at("WARC-IP-Address")).when(~of_wat, R.header("WARC-IP-Address")).alias("ip"),
        F.when(of_wat & ~incomplete, at("WARC-Target-URI")).when(~of_wat, R.header("WARC-Target-URI")).alias("url"),
    )
    malformed = F.col("url").rlike(r"^[^/]*//[^/?#]*[\[\]]") & F.col("host").isNull()
    host = F.when(F.coalesce(F.col("url"), F.lit("")) == "", F.lit(R.NO_HOST)).when(malformed, F.lit(R.NO_HOST)).otherwise(F.col("host"))
    rows = rows.withColumn("host", url.host_of(F.col("url"), simple_urls))
    return rows.select(host.alias("host"), F.coalesce(F.nullif("ip", F.lit("")), F.lit(R.NO_IP)).alias("ip")).groupBy("host", "ip").agg(F.count("*").alias("cnt"))


def tag_count(records: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """(key, val) of tag names in HTML responses."""
    pages = records.filter(R.is_response() & R.is_html())
    return _counted(pages.select(F.explode(text.tag_names(text.byte_text(F.col("payload")), case_insensitive)).alias("key")))


def word_frequencies(texts: DataFrame, column: str = "text", *by: str) -> DataFrame:
    """(by ..., key, tf, df): how often each word comes, and in how many rows.

    The words of a row are sorted, and the first of equal ones is marked, so that both counts come from one aggregation.
    """
    sorted_ = F.sort_array(text.words(F.col(column)))
    marked = F.transform("w", lambda w, i: F.struct(w.alias("key"), F.coalesce((F.get("w", i - 1) != w).cast("int"), F.lit(1)).alias("first")))
    rows = texts.select(*by, sorted_.alias("w")).select(*by, F.explode(marked).alias("x"))
    return rows.groupBy(*by, F.col("x.key").alias("key")).agg(F.count("*").alias("tf"), F.sum("x.first").cast("long").alias("df"))


def word_count(records: DataFrame) -> DataFrame:
    """(key, tf, df) of the words of WET records."""
    return word_frequencies(records.filter(R.is_wet_text()).select(F.decode("payload", "UTF-8").alias("text")))


def html_texts(records: DataFrame, mode: str = "strip") -> DataFrame:
    """Texts of HTML responses with their URL; ``parsed`` tells whether it could be done, else the text is empty."""
    pages = records.filter(R.is_response() & R.is_html())
    made = html.text_udf(mode)(F.col("payload"), R.header("WARC-Identified-Content-Charset"), F.get(R.http_values("content-type"), 0))
    return pages.select(R.header("WARC-Target-URI").alias("url"), made.alias("text")).select("url", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNotNull().alias("parsed"))


def parse_counts() -> list[Column]:
    """How many rows of html_texts() were parsed, and how many were not."""
    n = lambda c, name: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long").alias(name)
    return [n(F.col("parsed"), "records_parse_success"), n(~F.col("parsed"), "records_parse_failed")]


def html_word_count(records: DataFrame, mode: str = "strip") -> DataFrame:
    return word_frequencies(html_texts(records, mode))


def job_counters(records: DataFrame) -> DataFrame:
    """One row: records, files that failed, responses, WAT records and records without HTML."""
    n = lambda c: F.sum(c.cast("int")).cast("long")
    failed = F.col("error").isNotNull()
    return records.agg(
        n(~failed).alias("records_processed"), n(failed).alias("warc_input_failed"), n(R.is_response()).alias("records_response"), n(R.is_wat_json()).alias("records_response_wat"),
        n(R.is_response() & ~R.is_html()).alias("records_non_html"), n(R.is_redirect()).alias("records_response_redirect"),
    )
