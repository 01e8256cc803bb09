"""Approximate nearest neighbours: an inverted-file index over k-means cells.

The centres are fitted on a bounded sample; every row is assigned to a cell.  A query looks only into the
cells whose centres are nearest to it, so what is read falls with the number of cells.  Exact search in
``retrieve`` stays the default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.vectors import cosine
from quaestor.operators.retrieve import DIGITS

#: Rows that the centres are fitted on at most; the documented bound of the sample.
SAMPLE_ROWS = 50_000


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def fit_centres(index: DataFrame, cells: int, vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, rounds: int = 12) -> np.ndarray:
    """Unit centres by spherical k-means on at most ``sample_rows`` rows, those with the smallest hash; fewer rows than cells give fewer centres."""
    known = index.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    rows = known.select(vector_col, F.xxhash64(vector_col).alias("_h")).orderBy("_h").limit(sample_rows).collect()
    m = _unit(np.array([r[0] for r in rows], np.float64)) if rows else np.zeros((0, 1))
    m = m[np.any(m != 0, axis=1)]
    if not len(m):
        return np.zeros((0, 1))
    centres = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        centres = np.where(np.any(sums != 0, axis=1, keepdims=True), _unit(sums), centres)
    return centres


def assign_cells(index: DataFrame, centres: np.ndarray, vector_col: str = "embedding", probes: int = 1) -> DataFrame:
    """``index`` with ``cell``: the nearest centre of every row, or one row for each of its ``probes`` nearest ones.  Null and zero vectors are in no cell."""
    names = index.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema), "cell int"])
    at = names.index(vector_col)
    shared = index.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            rows = [(k, v) for k, v in enumerate(batch.column(at).to_pylist()) if v is not None and any(v)]
            if not rows or not len(c):
                continue
            sims = _unit(np.array([v for _, v in rows], np.float64)) @ c.T
            n = min(probes, len(c))
            near = np.argpartition(-sims, n - 1, axis=1)[:, :n]
            take = pa.array(np.repeat([k for k, _ in rows], n))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(names))), pa.array(near.ravel().astype(np.int32))], [*names, "cell"])

    return index.mapInArrow(run, schema)


def top_k_cells(queries: DataFrame, celled: DataFrame, centres: np.ndarray, k: int = 5, probes: int = 8, query_id: str = "query_id", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, id_col, sim, rank)`` from the ``probes`` nearest cells of each query, exact within them; ties by id.

    ``celled`` is the index with its cells; stored partitioned by cell, only the probed ones are read.
    Hot cells are split by adaptive execution.
    """
    asked = assign_cells(queries.select(F.col(query_id).alias("_q"), F.col(vector_col).alias("_v")), centres, "_v", probes)
    near = celled.join(asked, "cell").select("_q", F.col(id_col), F.round(cosine(F.col("_v"), F.col(vector_col)), DIGITS).alias("sim")).where("sim is not null")
    place = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("sim"), F.asc(id_col)))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("_q").alias(query_id), id_col, "sim", "rank")


def recall(exact: DataFrame, found: DataFrame, query_id: str = "query_id", id_col: str = "id") -> float:
    """The share of exact hits that were found; 1 if there are none."""
    both = exact.select(query_id, id_col).join(found.select(query_id, id_col), [query_id, id_col], "left_semi").count()
    return both / (exact.count() or 1) if exact.limit(1).count() else 1.0
