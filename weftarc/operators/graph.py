"""The host graph: vertices with dense ids in order of names, and edges of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftarc import shared
from weftarc.functions import tld, url


def names(edges: DataFrame) -> DataFrame:
    """Distinct (name) of both ends."""
    return edges.select(F.explode(F.array("s", "t")).alias("name")).filter("name IS NOT NULL").distinct()


def valid_hosts(vertices: DataFrame, tlds: DataFrame | None = None) -> DataFrame:
    """Names of several labels whose first is a top-level domain: of a table (tld), or by rule where there is none."""
    several = vertices.filter(F.col("name").contains("."))
    first = F.substring_index("name", ".", 1)
    if tlds is None:
        return several.filter(tld.by_rule(first))
    # a table of some thousand rows, whoever publishes it
    return several.join(F.broadcast(tlds.select("tld").distinct()), first == F.col("tld"), "left_semi")


def with_ids(vertices: DataFrame, partitions: int | None = None) -> DataFrame:
    """(name, id), 0 to n - 1 in order of names, without one task for all: a range partition counts on from those before it.

    The names are kept as a checkpoint in their partitions, as bounds are sampled anew by each run of a plan.
    """
    spark = vertices.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = vertices.select("name").repartitionByRange(n, "name").withColumn("part", F.spark_partition_id())
    ranged = shared.checkpointed(ranged)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    return ranged.withColumn("nth", nth).join(F.broadcast(before), "part").select("name", (F.col("before") + F.col("nth") - 1).cast("long").alias("id"))


def vertices(edges: DataFrame, normalize: bool = False, validate: bool = False, tlds: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    found = names(edges)
    if normalize:
        found = found.select(url.normalized_of(F.col("name")).alias("name")).dropna().distinct()
    if validate:
        found = valid_hosts(found, tlds)
    return with_ids(found, partitions)


def edges_of_ids(edges: DataFrame, ids: DataFrame, normalize: bool = False) -> DataFrame:
    """(s, t) of ids, without self-loops; edges whose ends have no id are dropped. normalize: ends are, before that."""
    if normalize:
        edges = edges.select(url.normalized_of(F.col("s")).alias("s"), url.normalized_of(F.col("t")).alias("t")).distinct()
    source, target = (ids.select(F.col("name").alias(n), F.col("id").alias(i)) for n, i in (("s", "s_id"), ("t", "t_id")))
    joined = edges.select("s", "t").filter("s <> t").join(source, "s").join(target, "t")
    return joined.select(F.col("s_id").alias("s"), F.col("t_id").alias("t"))


def load_or_make_ids(edges: DataFrame, table: str | None, **options) -> DataFrame:
    """Vertices of a saved table, or new ones, saved under its name."""
    spark = edges.sparkSession
    if table and spark.catalog.tableExists(table):
        return spark.table(table)
    ids = vertices(edges, **options)
    if table:
        ids.write.saveAsTable(table)
        return spark.table(table)
    return ids
