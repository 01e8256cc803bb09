"""Deduplication, lookups, unions, limits and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.plans.cut import cut


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order values for each key, as a later file overwrites an earlier one of the same name.

    An aggregate with map-side combining, so a key that many rows share stays cheap.  Order values must
    not be null and should be unique within a key; of equal ones the greatest remaining row is taken.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def lookup_source(texts: DataFrame, sidecars: DataFrame, first: Column, second: Column, default: Column) -> DataFrame:
    """``texts`` with ``source_url``: from the sidecar named ``first``, else ``second``, else ``default``.

    A sidecar that is there but has a null address counts as found.  Of several sidecars with one name
    the one with the greatest address is taken.  Both sides are joined by file name.
    """
    known = sidecars.groupBy("file").agg(F.max("source_url").alias("url")).where("file is not null")
    one = known.select(F.col("file").alias("_f1"), F.struct("url").alias("_s1"))
    two = known.select(F.col("file").alias("_f2"), F.struct("url").alias("_s2"))
    named = texts.withColumns({"_k1": first, "_k2": second, "_d": default})
    hit = named.join(one, F.col("_k1") == F.col("_f1"), "left").join(two, F.col("_k2") == F.col("_f2"), "left")
    url = F.when(F.col("_s1").isNotNull(), F.col("_s1.url")).when(F.col("_s2").isNotNull(), F.col("_s2.url")).otherwise(F.col("_d"))
    return hit.withColumn("source_url", url).drop("_k1", "_k2", "_d", "_f1", "_f2", "_s1", "_s2")


def union_folders(folders: list[DataFrame]) -> DataFrame:
    """All rows with ``folder_priority``, the position of the folder they come from."""
    marked = [df.withColumn("folder_priority", F.lit(k)) for k, df in enumerate(folders)]
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df)
    return out


def limit_per_group(df: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group.  Spark prunes each partition to the limit before it shuffles."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")


def numbered(df: DataFrame, order: list[Column], name: str = "n", base: int = 0) -> DataFrame:
    """``df`` with consecutive numbers from ``base + 1`` in the given order, without a one-task window.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the sizes of
    the partitions before it.  Order columns should identify a row.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.max(inside).alias("last")).collect()  # one row per partition
    skip, rows = base, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        rows.append((r["_part"], skip))
        skip += r["last"] + 1
    shift = F.broadcast(df.sparkSession.createDataFrame(rows, "_part long, _skip long"))
    return placed.withColumn("_part", part).join(shift, "_part").withColumn(name, F.col("_skip") + inside + 1).drop("_part", "_skip", "_m")


def assign_ids(df: DataFrame, order: list[Column], base: int = 0) -> DataFrame:
    """``df`` with ``id``: ``ids_1``, ``ids_2``, ... in the given order, continuing after ``base`` rows."""
    return numbered(df, order, "_n", base).withColumn("id", F.concat(F.lit("ids_"), F.col("_n").cast("string"))).drop("_n")
