"""Session defaults shared by the command line, the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.io.compression.codec": "zstd",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build(app: str = "weftarc", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; conf wins over them.

    Keyword names use ``__`` for dots: ``build(spark__driver__memory="8g")``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
