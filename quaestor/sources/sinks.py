"""Writing the tables of the offline flow.  Every run replaces what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import facts_name
from quaestor.sources.pages import text_files


def write_pages(pages: DataFrame, path: str, head: str, foot: str, order: str = "page_id") -> None:
    """``(file, text)``: trimmed pages with their address header; of pages with one name the last wins."""
    text_files(pages, head, foot, order).write.mode("overwrite").parquet(path)


def write_processed(files: DataFrame, path: str) -> None:
    """``(file, text, source_url)`` of the office files that could be read."""
    files.where("error is null").select("file", "text", "source_url").write.mode("overwrite").parquet(path)


def write_facts(facts: DataFrame, path: str) -> None:
    """``(file, chunk_no, pos, source, fact)`` as rows, named after their input file; of inputs with one name the last is taken.

    Rows and not arrays, so one huge file is many rows.  Files without facts have none, and nothing of
    an earlier run stays.
    """
    named = facts.withColumn("name", facts_name(F.col("file")))
    winners = named.groupBy("name").agg(F.max("file").alias("file"))
    kept = named.join(winners, ["name", "file"], "left_semi")
    kept.select(F.col("name").alias("file"), "chunk_no", "pos", "source", "fact").write.mode("overwrite").parquet(path)
