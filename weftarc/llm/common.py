"""What several operators share: scratch tables, streamed groups and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words, for split().
SPACE = r"[\x20\x09-\x0D]+"
#: Rows, of a few numbers each, up to which the side of a join may be broadcast.
BROADCAST = 200_000
#: Numbers, of 4 bytes, up to which rows with lists of them may be.
NUMBERS = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; one of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="weftarc-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return it as read from there: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are stored.

    Spark deletes them once the driver's objects for them are collected, which on a driver with memory to spare may be
    long after; until then they are disk on every executor.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(df: DataFrame) -> None:
    """Delete the files of a table that stored() wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, numbers: Column | None = None) -> DataFrame:
    """df, broadcast if it has at most BROADCAST rows of a few numbers each, which it counts; beyond, joined as any other.

    numbers: of rows with a list, how many numbers that has; then, the limit is NUMBERS in all.
    """
    if numbers is None:
        return F.broadcast(df) if df.count() <= BROADCAST else df
    rows, more = df.agg(F.count("*"), F.coalesce(F.sum(numbers), F.lit(0))).first()
    return F.broadcast(df) if 4 * rows + more <= NUMBERS else df


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column holds about ``most`` bytes in each; a longer single row stays whole."""
    for b in batches:
        if b.num_rows == 0:
            continue
        step = max(1, int(b.num_rows * most / max(1, b.column(column).nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of equal key from batches sorted by it; holds one run and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        keys = list(zip(*(b.column(k).to_pylist() for k in key)))
        start = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, k
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def arrow(f: Callable[..., Iterator[pa.RecordBatch]], df: DataFrame, schema, *args) -> DataFrame:
    """df.mapInArrow(f, schema) with further arguments for f. A worker, which is kept for later stages, gives back its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches, *args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def components(links: DataFrame, node: str = "node", hub: str = "hub") -> DataFrame:
    """Of a bipartite table of (node, hub) memberships, each node with the smallest node reachable: (node, component).

    Nodes of one hub are connected. Every round sends each hub the smallest label of its nodes, each node the
    smallest of its hubs, and then lets a node take the label of its label, so that long chains halve. Both steps
    are aggregations by key, which combine before they shuffle, so a hub or node with a third of all rows costs no
    more than others; the lookups are sort-merge joins, which Spark splits where a key is hot. Labels are written
    to the shared folder after each round; it ends when no label changes. Null nodes or hubs are left out.
    """
    spark = links.sparkSession
    edges = stored(links.select(F.col(node).alias("node"), F.col(hub).alias("hub")).dropna().distinct(), "edges")
    # a hub with one node connects nothing, but a node must not vanish with it
    labels = stored(edges.groupBy("hub").agg(F.min("node").alias("m")).join(edges, "hub").groupBy("node").agg(F.min("m").alias("label")), "labels")
    while True:
        low = edges.join(labels, "node").groupBy("hub").agg(F.min("label").alias("m"))
        near = edges.join(low, "hub").groupBy("node").agg(F.min("m").alias("label"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(
            near.join(labels.withColumnRenamed("label", "was"), "node").join(further, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels"
        )
        changed = after.filter("label <> was").limit(1).count()
        remove(labels)
        labels = after.select("node", "label")
        if not changed:
            remove(edges)
            return labels.withColumnRenamed("label", "component")
