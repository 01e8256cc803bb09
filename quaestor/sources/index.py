"""The vector index: a table of rows, written in append mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.vectors import norm
from quaestor.operators.relational import assign_ids
from quaestor.plans.cut import cut, scratch

#: Rows per file and batch.
BATCH = 5000


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The index at ``path``; a missing one is an error."""
    return spark.read.parquet(path)


def _rows_in(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return 0
    return spark.read.parquet(path).count()


#: Hex digits of a key that name its bucket.
_BUCKET_DIGITS = 2


def _keyed(rows: DataFrame, source: str, text: str) -> DataFrame:
    """``(key, bucket)`` added: a hash of source and text, and its first digits."""
    key = F.sha2(F.concat_ws("\x1f", F.coalesce(source, F.lit("\x00")), text), 256)
    return rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, _BUCKET_DIGITS))


def _keys(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The keys of all rows of an index, partitioned by bucket beside it; made anew where they are not as many as its rows."""
    beside = path.rstrip("/") + ".keys"
    if _rows_in(spark, beside) != rows:
        old = _keyed(open_index(spark, path).select("url", "document"), "url", "document").select("key", "bucket")
        old.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(beside)
    return spark.read.schema("key string, bucket string").parquet(beside)


def append_index(facts: DataFrame, path: str, order: list[Column], only_new: bool = False) -> None:
    """Add ``facts (source, fact, embedding)`` to the index with ids that continue after the rows already there.

    A repeated run adds all rows again; with ``only_new``, rows whose address and text are in the index
    already are left out, and repeated ones are added once.  For that the index has a table of keys beside
    it, of which only the buckets that the new rows fall into are read.
    """
    spark = facts.sparkSession
    base = _rows_in(spark, path)
    with scratch(spark):
        if only_new:
            facts = cut(_keyed(facts, "source", "fact").dropDuplicates(["key"]))
            if base:
                buckets = [r[0] for r in facts.select("bucket").distinct().collect()]  # 256 at most
                old = _keys(spark, path, base).where(F.col("bucket").isin(buckets)).select("key")
                facts = cut(facts.join(old, "key", "left_anti"))
        rows = assign_ids(facts, order, base)
        out = rows.select("id", F.col("fact").alias("document"), "embedding", F.col("source").alias("url"), norm(F.col("embedding")).alias("norm"))
        out.write.mode("append").option("maxRecordsPerFile", BATCH).parquet(path)
        if only_new:  # after the rows: if this fails, the numbers differ and the keys are made anew
            facts.select("key", "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path.rstrip("/") + ".keys")
