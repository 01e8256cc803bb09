"""The registered queries of the core, over whole tables, and their SQL counterparts for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.config import VERSIONS, PipelineConfig, config_for
from quaestor.functions import arrays, json, text
from quaestor.operators import ann, embed, facts, prompt, relational, retrieve
from quaestor.plans.cut import scratch_path
from quaestor.plans.pipeline import valid_queries
from quaestor.sources import index as index_source
from quaestor.sources import pages as page_source
from quaestor.sources import sinks
from quaestor.sources.files import with_sources

Query = Callable[[SparkSession, str], DataFrame]
_DEFAULTS: PipelineConfig = VERSIONS[1]

# Markers of the page trimming queries: what stands before the first heading, and after the copyright sign.
_HEAD, _FOOT = "\n# ", "©"
#: Limits that bite on small tables too; production has those of ``PipelineConfig``.
_CRAWL_LIMIT, _WRITE_BATCH = 20, 500
_NO_HIT, _APOLOGY, _SOURCES_TITLE = "Nothing was found.", "No answer could be made.", "Sources:"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, topk_batch(spark, d))


def _texts(spark: SparkSession, d: str, near: DataFrame) -> DataFrame:
    """For every query vector, the texts of the documents with the ids of its hits (a convention of the fixture)."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.coalesce("source", F.lit("Unknown")).alias("source_url"))
    return near.join(docs, "vec_id", "left").select("query_id", "rank", "text", "source_url")


# scans, projections and filters


def trim_head(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "scraped_pages").select("page_id", text.after_first(F.col("text"), _HEAD).alias("body"))


def trim_foot(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "scraped_pages").select("page_id", text.before_first(F.col("text"), _FOOT).alias("body"))


def trim_both(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "scraped_pages").select("page_id", text.between_markers(F.col("text"), _HEAD, _FOOT).alias("body"))


def safe_name(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "scraped_pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


def page_header(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "scraped_pages").select("page_id", text.page_header(F.col("url"), F.col("text")).alias("content"))


def page_files(spark: SparkSession, d: str) -> DataFrame:
    return page_source.text_files(_t(spark, d, "scraped_pages"), _HEAD, _FOOT, "page_id")


def crawl_limit(spark: SparkSession, d: str) -> DataFrame:
    return page_source.crawled_pages(_t(spark, d, "scraped_pages"), limit=_CRAWL_LIMIT).select("crawl_root", "page_id", F.length("text").alias("n_chars"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "scraped_pages").select("page_id", F.posexplode(F.coalesce("links", F.expr("cast(array() as array<string>)"))).alias("pos", "link"))


def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.explode(text.chunks(F.col("text"), _DEFAULTS.chunk_chars)).alias("c")).select("doc_id", "c.chunk_no", "c.chunk")


def passthrough_fact(spark: SparkSession, d: str) -> DataFrame:
    return facts.passthrough_facts(_t(spark, d, "documents"), "doc_id", "text")


def nonblank_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(~text.is_blank(F.col("line")))


def truthy_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.truthy_facts(_t(spark, d, "facts")).select("fact_id", "fact")


def facts_name(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "facts").select("fact_id", text.base_name(F.col("file")).alias("base"), text.facts_name(F.col("file")).alias("out_name"))


def code_fence(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chat_answers").select("answer_id", text.without_code_fence(F.col("answer")).alias("answer"))


def json_field_default(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", json.field(F.col("props"), "k", "unknown").alias("k"), json.field(F.col("props"), "source", "unknown").alias("source"))


def json_field_null(spark: SparkSession, d: str) -> DataFrame:
    """Objects without the field, with an explicit null and with a value; and no object at all."""
    value = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("source"), F.lit('"')))
    made = F.when(F.col("fact_id") % 3 == 0, F.lit("{}")).when(F.col("fact_id") % 7 != 0, F.concat(F.lit('{"source": '), value, F.lit("}")))
    return _t(spark, d, "facts").select("fact_id", json.field(made, "source", "unknown").alias("source"))


def fact_files(spark: SparkSession, d: str) -> DataFrame:
    """All facts written as fact files, one JSON list per file, and read again."""
    item = F.to_json(F.struct("source", "fact"))  # without fields that are null
    per = _t(spark, d, "facts").where("file is not null").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("pos", "fact_id", item.alias("j")))).alias("x"))
    texts = per.select("file", F.concat(F.lit("["), F.array_join(F.transform("x", lambda y: y["j"]), ", "), F.lit("]")).alias("text"))
    return facts.facts_of_files(texts)


def fact_table(spark: SparkSession, d: str) -> DataFrame:
    """The facts as the offline flow writes them, read back from its table."""
    rows = _t(spark, d, "facts").where("file is not null and pos is not null and fact is not null").select("file", F.lit(0).alias("chunk_no"), F.col("pos").cast("int").alias("pos"), "source", "fact")
    path = scratch_path(spark)
    sinks.write_facts(rows, path)
    return spark.read.parquet(path)


def index_append(spark: SparkSession, d: str) -> DataFrame:
    """All facts appended to an index twice: every row is there twice, and ids go on."""
    rows = facts.truthy_facts(_t(spark, d, "facts")).select("file", "pos", "fact_id", "source", "fact", F.array(F.lit(3.0).cast("float"), F.lit(4.0).cast("float")).alias("embedding"))
    order = [F.col("file").asc_nulls_first(), F.col("pos").asc_nulls_first(), F.col("fact_id").asc()]
    path = scratch_path(spark)
    for _ in range(2):
        index_source.append_index(rows, path, order)
    return index_source.open_index(spark, path).select("id", "document", "url", "norm")


def index_only_new(spark: SparkSession, d: str) -> DataFrame:
    """The same with rows that are there already left out: each source and text once, whatever is delivered again."""
    rows = facts.truthy_facts(_t(spark, d, "facts")).select("file", "pos", "fact_id", "source", "fact", F.array(F.lit(3.0).cast("float"), F.lit(4.0).cast("float")).alias("embedding"))
    order = [F.col("file").asc_nulls_first(), F.col("pos").asc_nulls_first(), F.col("fact_id").asc()]
    path = scratch_path(spark)
    for part in (rows.where("fact_id % 2 = 0"), rows):  # first a part of the table, then all of it
        index_source.append_index(part, path, order, only_new=True)
    return index_source.open_index(spark, path).select("document", "url")


def zipped_links(spark: SparkSession, d: str) -> DataFrame:
    """Each page's links with the pieces of its address, as far as both go."""
    return _t(spark, d, "scraped_pages").select("page_id", F.explode(arrays.zip_shortest(F.col("links"), F.split("url", "/"))).alias("z")).select("page_id", "z.a", "z.b")


def vector_slices(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in parts of 24 elements: where each begins and how many it has."""
    parts = F.posexplode(arrays.slices(F.col("embedding"), 24)).alias("part", "v")
    return _t(spark, d, "embeddings").select("vec_id", parts).select("vec_id", "part", F.size("v").alias("n"), F.round(F.col("v")[0].cast("double"), 6).alias("first"))


def source_default(spark: SparkSession, d: str) -> DataFrame:
    """Facts as a struct with a source, the file for those that have none, and address metadata."""
    src = F.coalesce("source", F.lit("Unknown Source"))
    return _t(spark, d, "facts").select("fact_id", src.alias("source"), F.create_map(F.lit("url"), src)["url"].alias("url"))


def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_nationkey").cast("string"))
    return _t(spark, d, "supplier").select("s_suppkey", text.markdown_row(cells).alias("row"))


def config_versions(spark: SparkSession, d: str) -> DataFrame:
    """Settings by region key, taken as a version number; unknown ones fall back."""
    rows = [(v, c.process_office_files, c.extract_with_model, c.crawl) for v in range(6) for c in [config_for(v)]]
    table = spark.createDataFrame(rows, "version long, process_office_files boolean, extract_with_model boolean, crawl boolean")
    return _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("version")).join(F.broadcast(table), "version")


# joins, sets and numbering


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    named = _t(spark, d, "scraped_pages").where("url is not null").select(text.safe_name(F.col("url")).alias("name"), "page_id", F.length("text").alias("n_chars"))
    return relational.last_per_key(named, ["name"], ["page_id"])


def sidecar_source(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "facts").select(F.regexp_replace("file", r"_facts\.json$", ".txt").alias("file")).distinct()
    return with_sources(files, _t(spark, d, "sidecars"))


def union_folders(spark: SparkSession, d: str) -> DataFrame:
    scraped = _t(spark, d, "scraped_pages").select(F.col("page_id").alias("id"), F.length("text").alias("n_chars"))
    processed = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n_chars"))
    return relational.last_per_key(relational.union_folders([scraped, processed]), ["id"], ["folder_priority"])


def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = facts.truthy_facts(_t(spark, d, "facts")).select("file", "pos", "fact_id")
    order = [F.col("file").asc_nulls_first(), F.col("pos").asc_nulls_first(), F.col("fact_id").asc()]
    return relational.assign_ids(rows, order, base=10).select("fact_id", "id")


def write_batches(spark: SparkSession, d: str) -> DataFrame:
    """How many facts go into each write batch, and its first and last number."""
    rows = facts.truthy_facts(_t(spark, d, "facts")).select("file", "pos", "fact_id")
    order = [F.col("file").asc_nulls_first(), F.col("pos").asc_nulls_first(), F.col("fact_id").asc()]
    n = relational.numbered(rows, order)
    batch = F.expr(f"(n - 1) div {_WRITE_BATCH}").alias("batch")
    return n.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first_n"), F.max("n").alias("last_n"))


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "facts").groupBy("source").agg(F.count(F.lit(1)).alias("n_facts"), F.count("fact").alias("n_texts"))


# retrieval


def topk_single(spark: SparkSession, d: str) -> DataFrame:
    index = _t(spark, d, "embeddings").select("vec_id", "embedding")
    query = index.where("vec_id = 0").first()
    near = retrieve.top_k_single(index, query["embedding"] if query else [], _DEFAULTS.top_k, "vec_id") if query else index.limit(0).withColumns({"sim": F.lit(0.0), "rank": F.lit(0)})
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return near.join(docs, "vec_id", "left").select("rank", "vec_id", "sim", F.coalesce("source", F.lit("Unknown")).alias("source"))


def topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries are the rows with an id divisible by 50, against all rows."""
    index = _t(spark, d, "embeddings").select("vec_id", "embedding")
    queries = index.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.top_k_batch(queries, index, _DEFAULTS.top_k, "query_id", "vec_id")


def topk_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same queries through the approximate index: 32 cells, 20 of them read."""
    index = _t(spark, d, "embeddings").select("vec_id", "embedding")
    queries = index.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centres = ann.fit_centres(index, 32)
    return ann.top_k_cells(queries, ann.assign_cells(index, centres), centres, _DEFAULTS.top_k, 20, "query_id", "vec_id")


# prompts and answers


def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    return prompt.labelled_context(_hits(spark, d)).select("query_id", "context")


def _vector_of(query_id: str) -> Column:
    """Which of the searched vectors stands for a chat query."""
    return F.pmod(query_id, F.lit(10)) * 50


def prompt_full(spark: SparkSession, d: str) -> DataFrame:
    asked = _t(spark, d, "chat_queries").where("query <> ''").select("query_id", "query", "field_of_study", "semester", _vector_of("query_id").alias("vec"))
    asked = asked.dropDuplicates(["query_id"])
    contexts = prompt.labelled_context(_hits(spark, d)).select(F.col("query_id").alias("vec"), "context")
    joined = asked.join(contexts, "vec", "left")
    return joined.select("query_id", prompt.full_prompt(F.col("query"), F.col("context"), F.col("field_of_study"), F.col("semester")).alias("prompt"))


def student_clause(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chat_queries").select("query_id", prompt.student_clause(F.col("field_of_study"), F.col("semester")).alias("clause"))


def query_rejects(spark: SparkSession, d: str) -> DataFrame:
    ok, bad = valid_queries(_t(spark, d, "chat_queries"))
    return ok.select("query_id", F.lit(False).alias("rejected")).union(bad.select("query_id", F.lit(True)))


def sources_ranked(spark: SparkSession, d: str) -> DataFrame:
    return prompt.labelled_context(_hits(spark, d)).select("query_id", F.array_join("sources", "|").alias("sources"))


def sources_distinct(spark: SparkSession, d: str) -> DataFrame:
    once = F.filter(F.array_distinct("sources"), lambda s: s.isNotNull())
    return _t(spark, d, "chat_answers").select("answer_id", F.size(F.coalesce("sources", F.expr("cast(array() as array<string>)"))).alias("n_all"), F.coalesce(F.array_join(once, "|"), F.lit("")).alias("once"))


def no_hit_answer(spark: SparkSession, d: str) -> DataFrame:
    """Every non-empty query answered from the hits of its vector; odd ones have none and get the fixed answer."""
    asked, _ = valid_queries(_t(spark, d, "chat_queries"))
    asked = asked.dropDuplicates(["query_id"])
    near = asked.where("query_id % 2 = 0").select("query_id", _vector_of("query_id").alias("vec"))
    hits = _hits(spark, d).withColumnRenamed("query_id", "vec").join(near, "vec").select("query_id", "rank", "text", "source_url")
    out = prompt.respond(asked, hits, _NO_HIT, _APOLOGY)
    return out.select("query_id", "answer", F.size("sources").alias("n_sources"))


def ui_format(spark: SparkSession, d: str) -> DataFrame:
    shown = prompt.shown_answer(F.coalesce("answer", F.lit("")), F.col("sources"), _SOURCES_TITLE)
    return _t(spark, d, "chat_answers").select("answer_id", shown.alias("shown"))


def chat_history(spark: SparkSession, d: str) -> DataFrame:
    """Each session's turns: a user turn for every delivered query, an assistant turn for every answer that is there."""
    asked = _t(spark, d, "chat_queries").where("session_id is not null").select("session_id", "query_id", "query", F.unix_micros("asked_at").alias("at"))
    said = _t(spark, d, "chat_answers").where("answer is not null").select("query_id", "answer_id", "answer", F.unix_micros("answered_at").alias("at"))
    owner = asked.groupBy("query_id").agg(F.min("session_id").alias("session_id"))
    user = asked.distinct().select("session_id", F.struct("at", F.lit(0).alias("side"), F.col("query_id").alias("id")).alias("turn"), F.lit("user").alias("role"), F.col("query").alias("text"))
    other = said.join(owner, "query_id").select("session_id", F.struct("at", F.lit(1).alias("side"), F.col("answer_id").alias("id")).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return prompt.history(user.union(other), "session_id")


# stand-ins for models


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors from the embedding interface, element by element."""
    vectors = _t(spark, d, "facts").where("fact is not null").select("fact_id", embed.embed_column(F.col("fact")).alias("v"))
    return vectors.select("fact_id", F.posexplode("v").alias("bucket", "x")).where("x > 0").select("fact_id", "bucket", F.round(F.col("x").cast("double"), 4).alias("value"))


def hash_embed_sparse(spark: SparkSession, d: str) -> DataFrame:
    """The same from JVM expressions alone."""
    return embed.hash_embedding(_t(spark, d, "facts"), "fact_id", "fact")


def facts_extractive(spark: SparkSession, d: str) -> DataFrame:
    found = facts.extracted_facts(_t(spark, d, "documents").where("text is not null"), "doc_id", "text", _DEFAULTS.chunk_chars)
    return found.select("doc_id", "chunk_no", "pos", "fact")


def answer_extractive(spark: SparkSession, d: str) -> DataFrame:
    queries = _t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("What is this about?").alias("query"), F.lit(None).cast("string").alias("field_of_study"), F.lit(None).cast("string").alias("semester"))
    out = prompt.respond(queries, _hits(spark, d), _NO_HIT, _APOLOGY)
    return out.select("query_id", "answer", F.array_join("sources", "|").alias("sources"))


def answer_chat(spark: SparkSession, d: str) -> DataFrame:
    """The whole flow over query texts: the stated chat queries, those with an id divisible by 50, are embedded, searched among all vectors and answered from their hits."""
    asked, _ = valid_queries(_t(spark, d, "chat_queries").where("query_id % 50 = 0").select("query_id", "query", "field_of_study", "semester"))
    asked = asked.dropDuplicates(["query_id"])
    vectors = asked.select("query_id", embed.embed_column(F.col("query")).alias("embedding"))
    near = retrieve.top_k_batch(vectors, _t(spark, d, "embeddings").select("vec_id", "embedding"), _DEFAULTS.top_k, "query_id", "vec_id")
    out = prompt.respond(asked, _texts(spark, d, near), _NO_HIT, _APOLOGY)
    return out.select("query_id", "answer", F.array_join("sources", "|").alias("sources"))


_NAMES = """
    topk_single topk_batch topk_cells trim_head trim_foot trim_both safe_name page_header page_files crawl_limit page_links chunk_fixed passthrough_fact
    nonblank_paragraphs truthy_facts facts_name code_fence json_field_default json_field_null fact_files fact_table index_append index_only_new zipped_links vector_slices source_default table_markdown config_versions last_wins
    sidecar_source union_folders assign_ids write_batches collection_counts prompt_context prompt_full student_clause query_rejects
    sources_ranked sources_distinct no_hit_answer ui_format chat_history hash_embed hash_embed_sparse facts_extractive answer_extractive answer_chat
""".split()


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in _NAMES}


def oracle_sql() -> dict[str, str]:
    from quaestor.plans import oracle

    return oracle.SQL
