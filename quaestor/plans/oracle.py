"""SQL for DuckDB with the results of the core queries."""

from __future__ import annotations

_AFTER = "CASE WHEN instr({t}, chr(10) || '# ') > 0 THEN substr({t}, instr({t}, chr(10) || '# ') + 3) ELSE {t} END"
_BEFORE = "CASE WHEN instr({t}, '©') > 0 THEN substr({t}, 1, instr({t}, '©') - 1) ELSE {t} END"
_BODY = _BEFORE.format(t="(" + _AFTER.format(t="text") + ")")
_NAME = "trim(replace(replace(url, 'https://', ''), '/', '_'), '_')"
_STRIP = r"regexp_replace(@, '^[\s\x0b\x1c-\x1f\x{85}\pZ]+|[\s\x0b\x1c-\x1f\x{85}\pZ]+$', '', 'g')"


def _strip(column: str) -> str:
    return _STRIP.replace("@", column)


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_TOPK = (
    f"SELECT query_id, vec_id, sim, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_COS} AS sim, "
    f"row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 5"
)
_HITS = f"SELECT k.query_id, k.rank, d.text, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(d.source, 'Unknown') END AS source_url FROM ({_TOPK}) k LEFT JOIN documents d ON d.doc_id = k.vec_id"
_CONTEXT = f"SELECT query_id, string_agg('[S' || rank || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM ({_HITS}) GROUP BY query_id"
_CLAUSE = (
    "CASE WHEN coalesce(field_of_study, '') <> '' AND coalesce(semester, '') <> '' THEN 'The user studies ' || field_of_study || ', term ' || semester || '.' "
    "WHEN coalesce(field_of_study, '') <> '' THEN 'The user studies ' || field_of_study || '.' ELSE '' END"
)
_TRUTHY = "FROM facts WHERE fact IS NOT NULL AND fact <> ''"
_NUMBERED = f"SELECT fact_id, row_number() OVER (ORDER BY file NULLS FIRST, pos NULLS FIRST, fact_id) AS n {_TRUTHY}"
_NL = "chr(10)"

# CRC-32 of a word's bytes, byte by byte over the table of all byte values.
_EMBED = r"""WITH w AS (SELECT fact_id, unnest(regexp_extract_all(lower(fact), '[\pL\pN]+')) AS w FROM facts WHERE fact IS NOT NULL),
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
b AS (SELECT w, list_transform(range(0, length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM w)),
c AS (SELECT w, (xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 64)::INT AS bucket FROM b, t),
n AS (SELECT fact_id, bucket, count(*) AS n FROM w JOIN c USING (w) GROUP BY ALL)
SELECT fact_id, bucket, {value} AS value FROM n JOIN (SELECT fact_id, sum(n * n) AS s FROM n GROUP BY 1) USING (fact_id)"""

SQL: dict[str, str] = {
    "trim_head": f"SELECT page_id, {_AFTER.format(t='text')} AS body FROM scraped_pages",
    "trim_foot": f"SELECT page_id, {_BEFORE.format(t='text')} AS body FROM scraped_pages",
    "trim_both": f"SELECT page_id, {_BODY} AS body FROM scraped_pages",
    "safe_name": f"SELECT page_id, {_NAME} AS name FROM scraped_pages",
    "page_header": "SELECT page_id, 'URL: ' || url || chr(10) || chr(10) || text AS content FROM scraped_pages",
    "page_files": f"SELECT {_NAME} || '.txt' AS file, arg_max('URL: ' || url || chr(10) || chr(10) || body, page_id) AS text "
    f"FROM (SELECT page_id, url, {_BODY} AS body FROM (SELECT page_id, url, coalesce(text, '') AS text FROM scraped_pages WHERE url IS NOT NULL)) GROUP BY 1",
    "crawl_limit": "SELECT crawl_root, page_id, length(coalesce(text, '')) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY crawl_root ORDER BY page_id) AS n "
    "FROM scraped_pages WHERE crawl_root IS NOT NULL AND url IS NOT NULL) WHERE n <= 20",
    "page_links": "SELECT page_id, (unnest(generate_series(1, len(links))) - 1)::INT AS pos, unnest(links) AS link FROM scraped_pages WHERE links IS NOT NULL",
    "chunk_fixed": "SELECT doc_id, i::INT AS chunk_no, substr(text, (i * 15000 + 1)::BIGINT, 15000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 14999) // 15000)) AS i FROM documents WHERE length(text) > 0)",
    "passthrough_fact": f"SELECT doc_id, {_strip('text')} AS fact FROM documents WHERE text IS NOT NULL",
    "nonblank_paragraphs": f"SELECT doc_id, (pos - 1)::INT AS pos, line FROM (SELECT doc_id, unnest(generate_series(1, len(lines))) AS pos, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)) WHERE {_strip('line')} <> ''",
    "truthy_facts": f"SELECT fact_id, fact {_TRUTHY}",
    "facts_name": r"SELECT fact_id, regexp_replace(file, '\.[^.]*$', '') AS base, regexp_replace(file, '\.[^.]*$', '') || '_facts.json' AS out_name FROM facts",
    "code_fence": "SELECT answer_id, CASE WHEN starts_with(answer, '```') THEN replace(replace(answer, '```json', ''), '```', '') ELSE answer END AS answer FROM chat_answers",
    "json_field_default": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'unknown') AS k, coalesce(json_extract_string(props, '$.source'), 'unknown') AS source FROM events",
    "source_default": "SELECT fact_id, coalesce(source, 'Unknown Source') AS source, coalesce(source, 'Unknown Source') AS url FROM facts",
    "table_markdown": "SELECT s_suppkey, '| ' || s_suppkey || ' | ' || s_name || ' | ' || s_nationkey || ' |' AS row FROM supplier",
    "config_versions": "SELECT r_regionkey::BIGINT AS version, r_regionkey IN (3, 4) AS process_office_files, r_regionkey IN (2, 3, 4) AS extract_with_model, r_regionkey > 2 AS crawl FROM region",
    "last_wins": f"SELECT {_NAME} AS name, max(page_id) AS page_id, arg_max({{'v': length(text)}}, page_id).v AS n_chars FROM scraped_pages WHERE url IS NOT NULL GROUP BY 1",
    "sidecar_source": r"""WITH files AS (SELECT DISTINCT regexp_replace(file, '_facts\.json$', '.txt') AS file FROM facts),
known AS (SELECT file, max(source_url) AS url FROM sidecars WHERE file IS NOT NULL GROUP BY file)
SELECT f.file, CASE WHEN a.file IS NOT NULL THEN a.url WHEN b.file IS NOT NULL THEN b.url ELSE f.file END AS source_url FROM files f
LEFT JOIN known a ON a.file = replace(f.file, '.txt', '.json') LEFT JOIN known b ON b.file = regexp_replace(f.file, '\.[^.]*$', '') || '.json'""",
    "union_folders": "SELECT id, arg_max({'v': n}, p).v AS n_chars, max(p) AS folder_priority FROM (SELECT page_id AS id, length(text) AS n, 0 AS p FROM scraped_pages UNION ALL SELECT doc_id, length(text), 1 FROM documents) GROUP BY id",
    "assign_ids": f"SELECT fact_id, 'ids_' || (n + 10) AS id FROM ({_NUMBERED})",
    "write_batches": f"SELECT (n - 1) // 500 AS batch, count(*) AS rows, min(n) AS first_n, max(n) AS last_n FROM ({_NUMBERED}) GROUP BY 1",
    "collection_counts": "SELECT source, count(*) AS n_facts, count(fact) AS n_texts FROM facts GROUP BY source",
    "topk_single": f"SELECT rank, k.vec_id, sim, coalesce(d.source, 'Unknown') AS source FROM ({_TOPK}) k LEFT JOIN documents d ON d.doc_id = k.vec_id WHERE query_id = 0",
    "topk_batch": _TOPK,
    "prompt_context": _CONTEXT,
    "prompt_full": f"SELECT q.query_id, 'Answer from the context and cite its labels.' || {_NL} || {_NL} || {_CLAUSE} || {_NL} || {_NL} || '---' || {_NL} || 'General knowledge.' || {_NL} || '---' || {_NL} || {_NL} || '---' || {_NL} || 'Context:' || {_NL} "
    f"|| coalesce(c.context, '') || {_NL} || '---' || {_NL} || {_NL} || 'Question: ' || q.query || {_NL} || {_NL} || 'Answer:' AS prompt "
    f"FROM (SELECT DISTINCT query_id, query, field_of_study, semester FROM chat_queries WHERE query <> '') q LEFT JOIN ({_CONTEXT}) c ON c.query_id = (q.query_id % 10) * 50",
    "student_clause": f"SELECT query_id, {_CLAUSE} AS clause FROM chat_queries",
    "query_rejects": "SELECT query_id, coalesce(query, '') = '' AS rejected FROM chat_queries",
    "sources_ranked": f"SELECT query_id, coalesce(string_agg(source_url, '|' ORDER BY rank), '') AS sources FROM ({_HITS}) GROUP BY query_id",
    "sources_distinct": "SELECT answer_id, coalesce(len(sources), 0)::INT AS n_all, coalesce(array_to_string(list_filter(sources, lambda x, i: x IS NOT NULL AND list_position(sources, x) = i), '|'), '') AS once FROM chat_answers",
    "no_hit_answer": f"SELECT q.query_id, CASE WHEN h.n IS NULL THEN 'Nothing was found.' ELSE {_strip('h.line')} END AS answer, coalesce(h.n, 0)::INT AS n_sources FROM (SELECT DISTINCT query_id FROM chat_queries WHERE query <> '') q "
    f"LEFT JOIN (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN split_part(coalesce(text, ''), chr(10), 1) END) AS line FROM ({_HITS}) GROUP BY 1) h ON q.query_id % 2 = 0 AND h.query_id = (q.query_id % 10) * 50",
    "json_field_null": "SELECT fact_id, CASE WHEN fact_id % 3 = 0 OR fact_id % 7 = 0 THEN 'unknown' ELSE source END AS source FROM facts",
    "fact_files": "SELECT file, (n - 1)::INT AS pos, coalesce(source, 'unknown') AS source, fact FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pos NULLS FIRST, fact_id) AS n FROM facts WHERE file IS NOT NULL) WHERE fact <> ''",
    "fact_table": r"""WITH f AS (SELECT regexp_replace(file, '\.[^.]*$', '') || '_facts.json' AS name, * FROM facts WHERE file IS NOT NULL AND pos IS NOT NULL AND fact IS NOT NULL)
SELECT name AS file, 0 AS chunk_no, pos::INT AS pos, source, fact FROM f WHERE file = (SELECT max(g.file) FROM f g WHERE g.name = f.name)""",
    "index_append": f"SELECT 'ids_' || (n + k * (SELECT count(*) {_TRUTHY})) AS id, fact AS document, source AS url, 5.0::DOUBLE AS norm FROM ({_NUMBERED}) JOIN facts USING (fact_id), (SELECT unnest([0, 1]) AS k)",
    "index_only_new": f"SELECT DISTINCT fact AS document, source AS url {_TRUTHY}",
    "zipped_links": "SELECT page_id, links[i] AS a, parts[i] AS b FROM (SELECT page_id, links, parts, unnest(generate_series(1, least(len(links), len(parts)))) AS i FROM (SELECT page_id, links, string_split(url, '/') AS parts FROM scraped_pages WHERE links IS NOT NULL AND url IS NOT NULL))",
    "vector_slices": "SELECT vec_id, p::INT AS part, least(24, len(embedding) - 24 * p)::INT AS n, round(embedding[24 * p + 1]::DOUBLE, 6) AS first FROM (SELECT vec_id, embedding, unnest(range(0, (len(embedding) + 23) // 24)) AS p FROM embeddings)",
    "hash_embed": _EMBED.format(value="round((n / sqrt(s))::FLOAT::DOUBLE, 4)"),
    "hash_embed_sparse": _EMBED.format(value="round(n / sqrt(s), 6)"),
    "ui_format": f"SELECT answer_id, coalesce(answer, '') || CASE WHEN len(once) > 0 THEN {_NL} || {_NL} || 'Sources:' || {_NL} || array_to_string(list_transform(once, lambda x: '- ' || x), {_NL}) ELSE '' END AS shown "
    "FROM (SELECT answer_id, answer, list_filter(sources, lambda x, i: x IS NOT NULL AND list_position(sources, x) = i) AS once FROM chat_answers)",
    "chat_history": "WITH asked AS (SELECT DISTINCT session_id, query_id, query, epoch_us(asked_at) AS moment FROM chat_queries WHERE session_id IS NOT NULL), owner AS (SELECT query_id, min(session_id) AS session_id FROM asked GROUP BY 1), "
    "turns AS (SELECT session_id, moment, 0 AS side, query_id AS id, 'user' AS role, query AS text FROM asked UNION ALL SELECT o.session_id, epoch_us(a.answered_at), 1, a.answer_id, 'assistant', a.answer FROM chat_answers a JOIN owner o USING (query_id) WHERE a.answer IS NOT NULL) "
    "SELECT session_id, count(*)::INT AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY moment, side, id, text NULLS FIRST) AS transcript FROM turns GROUP BY session_id",
    "facts_extractive": f"SELECT doc_id, chunk_no, (row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY p) - 1)::INT AS pos, fact FROM (SELECT doc_id, chunk_no, p, {_strip('line')} AS fact FROM (SELECT doc_id, chunk_no, unnest(generate_series(1, len(lines))) AS p, unnest(lines) AS line "
    "FROM (SELECT doc_id, i::INT AS chunk_no, string_split(substr(text, (i * 15000 + 1)::BIGINT, 15000), chr(10)) AS lines FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 14999) // 15000)) AS i FROM documents WHERE length(text) > 0)))) WHERE fact <> ''",
}
