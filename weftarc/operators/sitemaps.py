"""Sitemaps that robots.txt files announce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc import records as R
from weftarc.functions import text, url

MANY = 50


def announced(records: DataFrame) -> DataFrame:
    """A row for each robots.txt response: (robots_url, host, found, invalid, urls).

    urls: in order of lines, what follows ``Sitemap:`` up to white space, if it is UTF-8, joined to the URL of the
    robots.txt unless it has a scheme of the web. A file whose own URL cannot be parsed has none.
    """
    trimmed = F.transform(text.text_lines(text.byte_text(F.col("payload"))), lambda line: F.btrim(line, F.lit(" \t\n\r\x0b\x0c")))
    matches = F.filter(F.transform(trimmed, lambda line: F.regexp_extract(line, r"^(?i:sitemap):[ \t\n\r\x0b\x0c]*([^ \t\n\r\x0b\x0c]+)", 1)), lambda m: m != "")
    decoded = F.transform("matches", lambda m: F.try_validate_utf8(F.encode(m, "ISO-8859-1").cast("string")))
    rows = records.filter(R.is_response()).select(R.header("WARC-Target-URI").alias("robots_url"), matches.alias("matches"))
    rows = rows.select("robots_url", F.size("matches").alias("found"), F.filter(decoded, lambda v: v.isNotNull()).alias("raw"))
    valid = rows.withColumn("host", F.when(F.size("raw") > 0, url.robots_host_of(F.col("robots_url"))))
    return valid.select("robots_url", "host", "found", (F.col("found") - F.size("raw")).alias("invalid"), F.when((F.size("raw") > 0) & F.col("host").isNotNull(), F.col("raw")).otherwise(F.array().cast("array<string>")).alias("urls"))


def _each(files: DataFrame) -> DataFrame:
    """(robots_url, host, sitemap_url), a row for each that could be joined."""
    rows = files.select("robots_url", "host", F.explode("urls").alias("raw"))
    absolute = F.col("raw").startswith("http:") | F.col("raw").startswith("https:")
    rows = rows.withColumn("sitemap_url", F.when(absolute, F.col("raw")).otherwise(url.joined(F.col("robots_url"), F.col("raw"))))
    return rows.filter("sitemap_url IS NOT NULL").select("robots_url", "host", "sitemap_url")


def sitemaps(records: DataFrame, distinct_hosts: bool = False) -> DataFrame:
    """(sitemap_url, hosts): the robots.txt hosts that announce each sitemap, as often as they do, or each once."""
    return of_files(announced(records), distinct_hosts)


def of_files(files: DataFrame, distinct_hosts: bool = False) -> DataFrame:
    """sitemaps() of the rows that announced() gives."""
    gather = F.collect_set if distinct_hosts else F.collect_list
    return _each(files).groupBy("sitemap_url").agg(F.array_sort(gather("host")).alias("hosts"))


def counters(records: DataFrame) -> DataFrame:
    """One row with the counts of a run."""
    return announced(records).agg(*counted())


def counted() -> list[Column]:
    """The counts of rows that announced() gives."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    some = F.size("urls")
    return [
        F.count(F.lit(1)).alias("robots_txt_processed"),
        # a file with a bad URL of its own stops at its first valid sitemap
        n(F.when((F.col("host").isNull()) & (F.col("found") > F.col("invalid")), F.lit(1)).otherwise(F.col("found"))).alias("sitemap_urls_found"),
        n(F.when((F.col("host").isNull()) & (F.col("found") > F.col("invalid")), F.lit(0)).otherwise(F.col("invalid"))).alias("sitemap_url_invalid_encoding"),
        n((some > 0).cast("int")).alias("robots_txt_announcing_sitemap"), n((some > MANY).cast("int")).alias("robots_txt_with_more_than_50_sitemaps"),
    ]
