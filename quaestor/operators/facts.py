"""Facts from texts and from fact files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions import json, text
from quaestor.plans.cut import cut, sized


class FactExtractor(Protocol):
    """Turns a chunk of text into the raw response of a model, a JSON list of strings.  Made anew on each worker."""

    def extract(self, chunk: str) -> str: ...


class LineExtractor:
    """Every non-blank line is a fact.  A stand-in without meaning."""

    def extract(self, chunk: str) -> str:
        import json as j

        return j.dumps([line.strip() for line in chunk.split("\n") if line.strip()], ensure_ascii=False)


def passthrough_facts(df: DataFrame, file: str, body: str) -> DataFrame:
    """``(file, fact)``: one fact per text, the stripped text; blank texts give an empty one, null texts none."""
    return df.where(F.col(body).isNotNull()).select(file, text.strip(F.col(body)).alias("fact"))


def _responses(chunk: Column, make: Callable[[], FactExtractor]) -> Column:
    @F.pandas_udf("struct<response:string,failed:boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            rows = []
            for c in batch:
                try:
                    rows.append((model.extract(c), False))
                except Exception:  # a failing model spoils its file, not the job
                    rows.append((None, True))
            yield pd.DataFrame(rows, columns=["response", "failed"])

    return run(chunk)


def extracted_facts(df: DataFrame, file: str, body: str, size: int = 15000, make: Callable[[], FactExtractor] = LineExtractor) -> DataFrame:
    """``(file, chunk_no, pos, fact)``: texts cut into chunks, each read by the model.

    A response may stand in a code fence.  One that is no JSON list costs its chunk only; a failing model
    costs all facts of the file.  The responses are written once, so no chunk is read by the model twice,
    and only the names of failed files are gathered.
    """
    parts = df.select(file, F.explode(text.chunks(F.col(body), size)).alias("c")).select(file, "c.chunk_no", "c.chunk")
    read = cut(parts.withColumn("r", _responses(F.col("chunk"), make)).select(file, "chunk_no", "r.response", "r.failed"))
    spoiled = cut(read.where("failed").select(file).distinct())
    return facts_of_responses(read.join(sized(spoiled), file, "left_anti"), file)


def facts_of_responses(responses: DataFrame, file: str) -> DataFrame:
    """``(file, chunk_no, pos, fact)`` from ``(file, chunk_no, response)``."""
    lists = responses.select(file, "chunk_no", json.parse_list(text.without_code_fence(text.strip(F.col("response")))).alias("facts"))
    return lists.select(file, "chunk_no", F.posexplode("facts").alias("pos", "fact"))


def facts_of_files(files: DataFrame, keep_prefix: bool = False) -> DataFrame:
    """``(file, pos, source, fact)`` from fact files ``(file, text)``.

    Files that are no JSON list are left out.  A missing source is ``unknown``, a null one stays null.
    Facts that are null, empty, zero or false are dropped, blank ones kept.  A file with an item that is
    no object is left out whole, or, with ``keep_prefix``, from that item on.
    """
    items = files.withColumn("items", json.parse_facts(F.col("text"))).where("items is not null")
    first_bad = F.array_position(F.transform("items", lambda x: x["is_object"]), False)
    if keep_prefix:
        items = items.withColumn("items", F.when(first_bad > 0, F.slice("items", F.lit(1), (first_bad - 1).cast("int"))).otherwise(F.col("items")))
    else:
        items = items.where(first_bad == 0)
    rows = items.select("file", F.posexplode("items").alias("pos", "x")).where("x.truthy")
    return rows.select("file", "pos", text.or_default(F.col("x.source"), F.col("x.has_source"), "unknown").alias("source"), F.col("x.fact").alias("fact"))


def truthy_facts(df: DataFrame, fact: str = "fact") -> DataFrame:
    """Rows with a fact that is neither null nor empty; blank ones survive."""
    return df.where(F.col(fact).isNotNull() & (F.col(fact) != ""))
