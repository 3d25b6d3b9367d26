"""Top-level domains.

The full list changes and is a parameter: a text file of one domain a line, `#` for comments, as IANA publishes it. The
default is a rule: two letters (countries), ``xn--`` labels, and the domains below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Generic top-level domains in common use.
GENERIC = (
    "academy aero agency app art arpa asia bank bar berlin bio biz blog business buzz cafe camp cat center chat church city click clinic "
    "cloud club coach codes com community company coop design dev digital direct directory edu education email energy events "
    "expert farm fashion fit foundation fun fund fyi gallery games global gov green group guide guru health help host hosting house "
    "info ink institute int international jobs land law legal life link live london ltd market marketing media mil mobi money "
    "museum name net network news ngo ninja nyc one online org page paris party photo photos post press pro pub rocks run school "
    "science services shop site social software solutions space store studio support systems tech tel today tools top tours "
    "trade travel university video vip watch website wiki win work works world xxx xyz zone"
).split()


def table(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(tld) of a list file, or null for the rule."""
    if path is None:
        return None
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("tld")).filter("tld <> '' AND NOT startswith(tld, '#')").distinct()


def by_rule(label: Column) -> Column:
    return label.rlike("^[a-z]{2}$") | label.startswith("xn--") | label.isin(GENERIC)
