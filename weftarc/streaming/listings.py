"""Archives as they arrive: a folder into which listings are put is a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftarc.operators import counts
from weftarc.sources import archives


def records(spark: SparkSession, folder: str, base: str | None = None, files_a_batch: int = 100, types: list[str] | None = None) -> DataFrame:
    """A stream of the records of all archives that text files in the folder list, each listing read once."""
    listed = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    return archives.of_listing(listed.select(F.trim("value").alias("uri")).filter("uri <> ''"), base, types=types)


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream as Parquet, exactly once; once: what is there now, then end."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def word_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Word frequencies of each batch of WET records, written under its number, so that a batch that runs again replaces itself.

    Sum over the batches for totals; the state of a stream would grow with the vocabulary.
    """

    def batch(rows: DataFrame, n: int) -> None:
        counts.word_count(rows).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
