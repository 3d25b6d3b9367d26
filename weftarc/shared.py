"""The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def base(spark: SparkSession) -> str:
    """The shared folder; one of this process's own only where the setting is missing, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="weftarc-"))
    return _own[0]


def folder(spark: SparkSession, name: str) -> str:
    """A new path in it."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder in its partitions; lineage ends here."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(base(df.sparkSession))
    return df.checkpoint()
