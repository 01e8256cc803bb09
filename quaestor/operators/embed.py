"""Embedding models behind one interface, and a deterministic stand-in."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import tokens


class Embedder(Protocol):
    """Turns texts into vectors.  Made anew on each worker, so the model is loaded once per Python process.

    A class or any callable that can be pickled makes one; arguments are bound with ``functools.partial``.
    """

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Counts tokens by the CRC-32 of each modulo ``size`` and scales to length 1.  A stand-in without meaning."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for word in re.findall(r"[^\W_]+", text.lower()):
                row[zlib.crc32(word.encode()) % self.size] += 1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def embed_column(text: Column, make: Callable[[], Embedder] = HashEmbedder) -> Column:
    """``ARRAY<FLOAT>`` for each text, in Arrow batches; null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(list(model.embed(batch.fillna("").tolist()).astype(np.float32)))

    return run(text)


def hash_embedding(df: DataFrame, id_col: str, text_col: str, size: int = 64) -> DataFrame:
    """The stand-in's vectors in sparse form, ``(id_col, bucket, value)``, from JVM expressions alone; values to 6 digits."""
    words = df.select(id_col, F.explode(tokens(F.col(text_col))).alias("w"))
    counts = words.groupBy(id_col, F.pmod(F.crc32("w"), F.lit(size)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(total, id_col).select(id_col, "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("value"))
