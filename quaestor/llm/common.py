"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as in Unicode-aware regular expressions of most languages, for Java's character classes.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_of(url: Column) -> Column:
    """Host of an address, lower-cased, without user, port and a leading ``www.``; null for null or host-less ones."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    bare = F.lower(F.regexp_extract(url, r"^\s*([^/?#:\s]+\.[^/?#:\s]+)", 1))
    picked = F.regexp_replace(F.when(host != "", host).otherwise(bare), r"^www\.", "")
    return F.when(picked != "", picked)
