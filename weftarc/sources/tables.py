"""Tables beside archives: URL indexes, coordinates, edges and plain files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def index(spark: SparkSession, path: str, view: str = "ccindex", schema: str | None = None) -> DataFrame:
    """A Parquet URL index as a temporary view; schema: the JSON of a StructType, where inferring it is not wanted."""
    reader = spark.read
    if schema:
        reader = reader.schema(StructType.fromJson(__import__("json").loads(schema)))
    df = reader.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def coordinates(spark: SparkSession, path: str, format: str | None = None, csv: bool = False, **options: str) -> DataFrame:
    """Places of records in any format that Spark reads; csv: with a header and inferred types."""
    if csv == (format is not None):
        raise ValueError("give either csv=True or a format")
    if csv:
        return spark.read.options(header="true", inferSchema="true", **options).csv(path)
    return spark.read.format(format).options(**options).load(path)


def edges(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """Edges (s, t): of one table as they are; of several, each once."""
    df = spark.read.load(path)
    for p in more:
        df = df.union(spark.read.load(p))
    return df.distinct() if more else df


def tsv_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges (s, t) of lines with a tab between."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.get(parts, 0).alias("s"), F.get(parts, 1).alias("t")).filter("t IS NOT NULL")


def spread(scan: DataFrame) -> DataFrame:
    """A scan, dealt out to all cores if it has fewer splits than those: a file of one row group is one task's, however long its rows take.

    Such an input is at most some splits long, so what moves is small; larger ones stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, modificationTime, length, content) of any files."""
    return spark.read.format("binaryFile").load(path)
