"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import answers, contamination, near_duplicates, packing, pages, site_lines, spans, split
from quaestor.llm.common import table
from quaestor.plans.cut import cut, sized

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "scraped_pages"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_repeated_lines(table(spark, d, "scraped_pages"))


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.block_report(table(spark, d, "scraped_pages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defective_answers(table(spark, d, "chat_answers"), table(spark, d, "chat_queries")).select("answer_id", "defect")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split.cut_kinds(table(spark, d, "scraped_pages"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(table(spark, d, "scraped_pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.body_lines(table(spark, d, "scraped_pages")).select("page_id", F.col("line_no").cast("bigint").alias("line_no"))


def p4_main_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.main_text(table(spark, d, "scraped_pages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    facts = near_duplicates.similar_pairs(table(spark, d, "facts"), "fact_id", "fact")
    web = table(spark, d, "scraped_pages")
    found = cut(near_duplicates.similar_pairs(web, "page_id", "text"))
    ends = found.select(F.col("a").alias("page_id")).union(found.select("b")).distinct()
    residue = pages.residue_pages(web.join(ends, "page_id", "left_semi")).select("page_id")  # only of pages in a pair
    residue = cut(residue)
    proper = found.join(residue.withColumnRenamed("page_id", "a"), "a", "left_anti").join(residue.withColumnRenamed("page_id", "b"), "b", "left_anti")
    both = facts.select(F.lit("facts").alias("tbl"), "a", "b").union(proper.select(F.lit("scraped_pages"), "a", "b"))
    return both.select("tbl", F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p5_fact_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_groups(table(spark, d, "facts"), "fact_id", "fact")


def p5_page_groups(spark: SparkSession, d: str) -> DataFrame:
    web = table(spark, d, "scraped_pages")

    def residue(ids: DataFrame) -> DataFrame:
        some = web.join(sized(cut(ids.withColumnRenamed("id", "page_id"))), "page_id", "left_semi")
        return pages.residue_pages(some).select(F.col("page_id").alias("id"))

    return near_duplicates.duplicate_groups(web, "page_id", "text", left_out=residue)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.residue_pages(table(spark, d, "scraped_pages")).select("page_id")


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    return pages.residue_pages(table(spark, d, "scraped_pages"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents")).where("n_pieces > 1 and piece_no = 1").select("doc_id")


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where(F.col("run") >= contamination.WINDOW).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents")).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_characters(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can express; the others are tested against brute force in tests/llm."""
    return {
        "p1_found": f"""WITH l AS (SELECT page_id, site, line_no, regexp_replace(lower(line), '[^\\pL]', '', 'g') AS k FROM (
SELECT page_id, site, unnest(generate_series(1, len(lines))) AS line_no, unnest(lines) AS line FROM (
SELECT page_id, {_SITE} AS site, string_split(text, chr(10)) AS lines FROM scraped_pages WHERE url IS NOT NULL AND text IS NOT NULL)) WHERE site <> ''),
r AS (SELECT site, k FROM l WHERE k <> '' GROUP BY ALL HAVING count(DISTINCT page_id) >= 5)
SELECT page_id, line_no::BIGINT AS line_no FROM l JOIN r USING (site, k)""",
        "p1_clean": f"""WITH l AS (SELECT page_id, site, line_no, line, regexp_replace(lower(line), '[^\\pL]', '', 'g') AS k FROM (
SELECT page_id, site, unnest(generate_series(1, len(lines))) AS line_no, unnest(lines) AS line FROM (
SELECT page_id, {_SITE} AS site, string_split(text, chr(10)) AS lines FROM scraped_pages WHERE text IS NOT NULL))),
r AS (SELECT site, k, true AS gone FROM l WHERE k <> '' AND site <> '' GROUP BY ALL HAVING count(DISTINCT page_id) >= 5),
c AS (SELECT page_id, count(gone)::INT AS removed, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE gone IS NULL), '') AS text FROM l LEFT JOIN r USING (site, k) GROUP BY page_id)
SELECT p.page_id, coalesce(c.removed, 0)::INT AS removed, c.text FROM scraped_pages p LEFT JOIN c USING (page_id)""",
        "p3_found": "SELECT page_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\pZ]+'), lambda x: length(x))) > 15000 "
        "THEN 'forced' ELSE 'natural' END AS cut_kind FROM scraped_pages WHERE length(text) > 15000",
        "p7_found": f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{_RE2_TOKEN}')) > 2048",
        "p8_found": f"""WITH i AS (SELECT item_id AS id, {_words("question || ' ' || answer")} AS w FROM eval_items), d AS (SELECT doc_id AS id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT id, array_to_string(w[p : p + 11], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12)),
dw AS (SELECT id, array_to_string(w[p : p + 11], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12))
SELECT DISTINCT dw.id AS doc_id, iw.id AS item_id FROM dw JOIN iw USING (s)""",
        "p9_found": """WITH s AS (SELECT doc_id, hash(substr(text, p, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS p FROM documents WHERE length(text) >= 300)),
m AS (SELECT DISTINCT h, doc_id FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(DISTINCT doc_id) > 1))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id""",
        "p9_shared": """WITH s AS (SELECT doc_id, p, hash(substr(text, p, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS p FROM documents WHERE length(text) >= 300)),
m AS (SELECT doc_id, p FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
g AS (SELECT doc_id, least(300, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 300)) AS n FROM m)
SELECT doc_id, length(d.text)::INT AS n_chars, c.n::INT AS shared_chars FROM (SELECT doc_id, sum(n) AS n FROM g GROUP BY 1) c JOIN documents d USING (doc_id)""",
    }


_SITE = "regexp_replace(lower(regexp_extract(url, '^\\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"
_RE2_TOKEN = r"[\pL\pN_]+|[^\pL\pN_\s\x0b\x1c-\x1f\x{85}\pZ]+"


def _words(column: str) -> str:
    folded = f"replace(strip_accents(lower(regexp_replace({column}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]', '', 'g'))), 'ł', 'l')"
    return f"regexp_extract_all({folded}, '[\\pL\\pN]+')"
