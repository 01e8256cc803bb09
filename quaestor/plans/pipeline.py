"""The two dataflows: building the index offline, and answering questions from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.config import PipelineConfig
from quaestor.operators.embed import Embedder, HashEmbedder, embed_column
from quaestor.operators.facts import FactExtractor, LineExtractor, extracted_facts, passthrough_facts, truthy_facts
from quaestor.operators.prompt import Answerer, ExtractiveAnswerer, PromptTemplate, respond
from quaestor.operators.retrieve import top_k_batch
from quaestor.sources.index import append_index, open_index


def facts_table(texts: DataFrame, config: PipelineConfig, extractor: Callable[[], FactExtractor] = LineExtractor) -> DataFrame:
    """``(file, chunk_no, pos, source, fact)`` from ``texts (file, text, source_url)``, one fact per text or what a model extracts."""
    if config.extract_with_model:
        found = extracted_facts(texts, "file", "text", config.chunk_chars, extractor)
    else:
        found = passthrough_facts(texts, "file", "text").select("file", F.lit(0).alias("chunk_no"), F.lit(0).alias("pos"), "fact")
    sources = texts.select("file", F.col("source_url").alias("source"))
    return truthy_facts(found.join(sources, "file").select("file", "chunk_no", "pos", "source", "fact"))


def build_index(texts: DataFrame, path: str, config: PipelineConfig, embedder: Callable[[], Embedder] = HashEmbedder, extractor: Callable[[], FactExtractor] = LineExtractor, only_new: bool = False) -> None:
    """Texts to facts to vectors to the index at ``path``."""
    facts = facts_table(texts, config, extractor).withColumn("embedding", embed_column(F.col("fact"), embedder))
    append_index(facts, path, [F.col("file"), F.col("chunk_no"), F.col("pos")], only_new)


def valid_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that may be answered, and the rejected ones: null and empty; blank ones pass."""
    ok = F.coalesce(F.col("query") != "", F.lit(False))
    return queries.where(ok), queries.where(~ok)


def answer(spark: SparkSession, queries: DataFrame, index_path: str, no_hit: str, apology: str, k: int = 5, embedder: Callable[[], Embedder] = HashEmbedder, answerer: Callable[[], Answerer] = ExtractiveAnswerer, template: PromptTemplate = PromptTemplate()) -> DataFrame:
    """``(query_id, answer, sources)`` for ``queries (query_id, query, field_of_study, semester)``."""
    asked, _ = valid_queries(queries)
    vectors = asked.select("query_id", embed_column(F.col("query"), embedder).alias("embedding"))
    index = open_index(spark, index_path)
    near = top_k_batch(vectors, index, k)
    hits = near.join(index.select("id", F.col("document").alias("text"), F.coalesce("url", F.lit("Unknown")).alias("source_url")), "id")
    return respond(asked, hits.select("query_id", "rank", "text", "source_url"), no_hit, apology, template, answerer)
