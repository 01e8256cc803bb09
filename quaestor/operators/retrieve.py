"""Exact cosine top-k: one query as an expression, many queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quaestor.functions.vectors import cosine

#: Similarities are rounded to so many digits before ranking, so that ties do not hang on the last bit.
DIGITS = 6
#: Query vectors that an Arrow batch of the index is multiplied with at a time, and those that one pass over the index serves.
BLOCK = 512
PASS = 32 * BLOCK


def top_k_single(index: DataFrame, query: list[float], k: int = 5, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``index`` with ``sim`` and ``rank`` for the k rows most similar to one vector, ties by id.

    A sort with a limit: every partition keeps k rows.  Zero and null vectors are never hits; an index
    with fewer rows gives fewer hits.
    """
    vector = F.array(*(F.lit(float(x)) for x in query))
    near = index.withColumn("sim", F.round(cosine(F.col(vector_col), vector), DIGITS)).where("sim is not null")
    best = near.orderBy(F.desc("sim"), F.asc(id_col)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), F.asc(id_col))))  # over k rows


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an ``ARRAY<FLOAT>`` column scaled to length 1, and their places in it; null, zero and incomplete vectors are left out."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    if not flat.null_count and not column.null_count and len(sizes) and sizes[0] and (sizes == sizes[0]).all():
        m, at = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, sizes[0]), np.arange(len(sizes))
    else:
        known = [(k, v) for k, v in enumerate(column.to_pylist()) if v and None not in v]
        m, at = np.array([v for _, v in known], np.float64), np.array([k for k, _ in known], np.int64)
    if not len(m):
        return np.zeros((0, 1)), np.zeros(0, np.int64)
    length = np.linalg.norm(m, axis=1)
    return m[length > 0] / length[length > 0, None], at[length > 0]


def top_k_batch(queries: DataFrame, index: DataFrame, k: int = 5, query_id: str = "query_id", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, id_col, sim, rank INT)``: for each query vector the k most similar rows of the index, ties by id.

    The stated queries go to the executors, ``PASS`` of them for one pass over the index; each Arrow batch
    is multiplied with them block by block, and every partition keeps k rows per query, so what is shuffled
    is k rows per query and partition, however large the index.  Zero and null vectors are never hits.
    """
    spark = index.sparkSession
    schema = f"query_id long, id {index.schema[id_col].dataType.simpleString()}, sim double"
    kind = to_arrow_type(index.schema[id_col].dataType)
    rows = index.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")

    def one_pass(some: list[tuple[int, list[float]]]) -> DataFrame:
        vectors = np.array([v for _, v in some], np.float64)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in some], np.int64), vectors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit = shared.value
            floors = np.full(len(ids), -2.0)
            best: list[list[tuple[float, object]]] = [[] for _ in ids]  # the k best so far of this partition
            for batch in batches:
                m, at = matrix(batch.column(1))
                if not len(m):
                    continue
                names = batch.column(0).take(pa.array(at)).to_pylist()
                for start in range(0, len(ids), BLOCK):
                    sims = np.round(m @ unit[start : start + BLOCK].T, DIGITS)
                    good = sims >= floors[start : start + BLOCK]
                    for q in np.flatnonzero(good.any(axis=0)).tolist():
                        some_rows = np.flatnonzero(good[:, q])
                        if len(some_rows) > 4 * k:  # the first batches: the k best are among those that reach the k-th similarity
                            values = sims[some_rows, q]
                            some_rows = some_rows[values >= np.partition(values, -k)[-k]]
                        ranked = sorted([*best[start + q], *((-sims[j, q], names[j]) for j in some_rows.tolist())])[:k]
                        best[start + q] = ranked
                        if len(ranked) == k:
                            floors[start + q] = -ranked[-1][0]
            sizes = [len(x) for x in best]
            flat = pa.array([n for x in best for _, n in x], kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), flat, pa.array([float(-s) for x in best for s, _ in x], pa.float64())], ["query_id", "id", "sim"])

        return rows.mapInArrow(run, schema)

    out, some = spark.createDataFrame([], schema), []
    for r in queries.select(F.col(query_id).cast("long"), F.col(vector_col)).where(f"{query_id} is not null and {vector_col} is not null").toLocalIterator():
        if any(r[1]) and None not in r[1]:
            some.append((r[0], r[1]))
        if len(some) == PASS:
            out, some = out.union(one_pass(some)), []
    if some:
        out = out.union(one_pass(some))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("id")))
    best = out.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "sim", "rank")
