"""Fact files that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaestor.functions.text import normal_newlines
from quaestor.operators.embed import embed_column
from quaestor.operators.facts import facts_of_files
from quaestor.sources.index import append_index


def stream_facts(spark: SparkSession, folder: str, index_path: str, checkpoint: str) -> StreamingQuery:
    """Read all fact files not yet seen, embed their facts and append them to the index; ends when none is left.

    The checkpoint remembers the files; a batch that is run again adds nothing twice.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").schema("value string").load(folder)
    named = files.select(F.col("_metadata.file_name").alias("file"), normal_newlines(F.col("value")).alias("text"))

    def add(batch: DataFrame, _: int) -> None:
        facts = facts_of_files(batch).withColumn("embedding", embed_column(F.col("fact")))
        append_index(facts, index_path, [F.col("file"), F.col("pos")], only_new=True)  # leaves no table of its own behind

    return named.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
