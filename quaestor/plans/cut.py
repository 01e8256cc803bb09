"""Cutting lineage: intermediate results that several later steps read are written once."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few numbers a row) is sent to every executor.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share.

    Only in local mode, where driver and executors are one process, an unset value is replaced by a
    temporary folder; on a cluster it is an error, since a machine-local folder would be lost with its
    executor.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not (conf.get("spark.master") or spark.sparkContext.master).startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if _LOCAL is None or not os.path.isdir(_LOCAL):
        _LOCAL = tempfile.mkdtemp(prefix="quaestor-")
    return "file://" + _LOCAL


_LOCAL: str | None = None


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and return it read back.

    The table survives the loss of executors.  It is removed when the application ends, or, made inside
    ``scratch``, when that ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, whose content is removed when the application or the innermost ``scratch`` ends."""
    path = f"{shared_dir(spark)}/quaestor-{uuid.uuid4().hex}"
    fs, target = _target(spark, path)
    fs.deleteOnExit(target)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are removed at the end; for work that writes its result before that, such as a batch of a stream."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            fs, target = _target(spark, path)
            fs.delete(target, True)
            fs.cancelDeleteOnExit(target)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table that was cut, marked for broadcast if it is counted to have at most ``rows`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
