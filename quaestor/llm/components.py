"""Connected components of a graph given by its links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.plans.cut import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, component)`` for each end of ``links (a, b)``: the smallest id that it is connected with.

    Alternating large-star and small-star steps; a hub never needs more than one row per neighbour, and
    the number of rounds grows with the logarithm of the longest path.  Stops when the links are the same as
    before, by count and three hash sums; running out of rounds is an error.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        h = F.xxhash64("u", "v")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.union(edges.select("v", "v")).groupBy("id").agg(F.min("component").alias("component"))
