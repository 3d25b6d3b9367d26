"""Checksums of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def md5(files: DataFrame) -> DataFrame:
    """(uri, md5) of (path, content) rows; a file that is listed twice has one row."""
    return files.select(F.col("path").alias("uri"), F.md5("content").alias("md5")).distinct()
