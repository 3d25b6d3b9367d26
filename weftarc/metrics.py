"""Counts of a run, taken as its records pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftarc import records as R


class Counters:
    """Observes a DataFrame of records, and more on the way; values() is for after the action that reads them.

    files: (uri) of the files that were to be read, counted against those that failed.
    """

    def __init__(self, records: DataFrame, files: DataFrame | None = None):
        n = lambda c, name: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long").alias(name)
        failed = F.col("error").isNotNull()
        self.files = files
        self.seen: list[Observation] = []
        # a row with an error is a file that ended early or, where single records are fetched, a record
        self.records = self.also(
            records, n(~failed, "records_processed"), n(failed, "records_failed"), n(R.is_response(), "records_response"), n(R.is_wat_json(), "records_response_wat"),
            n(R.is_response() & ~R.is_html(), "records_non_html"), n(R.is_redirect(), "records_response_redirect"), n(R.in_robots_file() & R.is_response(), "records_response_robotstxt"),
        )

    def also(self, df: DataFrame, *counts: Column) -> DataFrame:
        """df, with more counts of its rows."""
        self.seen.append(Observation())
        return df.observe(self.seen[-1], *counts)

    def values(self) -> dict[str, int]:
        out = {k: v for seen in self.seen for k, v in seen.get.items()}
        if self.files is not None:
            out["warc_input_failed"] = out.pop("records_failed")
            out["warc_input_processed"] = self.files.count() - out["warc_input_failed"]
        return out
