"""Queries over a URL index, and the records that they point at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftarc.sources import archives, tables


def query(spark: SparkSession, path: str, sql: str, view: str = "ccindex", schema: str | None = None) -> DataFrame:
    """Any Spark SQL over the index, which is the view named."""
    tables.index(spark, path, view, schema)
    return spark.sql(sql)


def export(df: DataFrame, table: str, partitions: int = 10, format: str = "parquet", **options: str) -> int:
    """Save the result of a query as a table; gives its rows, counted as they are written."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    df.repartition(partitions).observe(seen, F.count(F.lit(1)).alias("rows")).write.format(format).options(**options).saveAsTable(table)
    return seen.get["rows"]


def records(rows: DataFrame, base: str | None = None, partitions: int = 400, **options) -> DataFrame:
    """The archive records at the places that rows give, dealt out evenly before they are fetched."""
    return archives.at_offsets(rows, base, partitions, **options)
