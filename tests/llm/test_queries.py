import os

import duckdb
import pytest

from quaestor.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

# Columns that are prescribed.
FOUND = {
    "p1_found": [("page_id", "bigint"), ("line_no", "bigint")],
    "p2_found": [("answer_id", "bigint"), ("defect", "string")],
    "p3_found": [("page_id", "bigint"), ("cut_kind", "string")],
    "p4_found": [("page_id", "bigint"), ("line_no", "bigint")],
    "p5_found": [("tbl", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
    "p6_found": [("page_id", "bigint")],
    "p7_found": [("doc_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p9_found": [("doc_a", "bigint"), ("doc_b", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name in FOUND:
        assert df.dtypes == FOUND[name]
        assert len(set(got)) == len(got)
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
        want = con.sql(queries.oracle_sql()[name])
        assert df.columns == want.columns
        assert sorted(got) == sorted(want.fetchall())


def test_residue_pages_have_no_body_and_no_versions(spark):
    q = queries.queries()
    residue = {r[0] for r in q["p6_found"](spark, DATA).collect()}
    assert residue and not residue & {r[0] for r in q["p4_found"](spark, DATA).collect()}
    pairs = [tuple(r) for r in q["p5_found"](spark, DATA).collect()]
    pages = {i for t, a, b in pairs if t == "scraped_pages" for i in (a, b)}
    assert not residue & pages and all(a < b for _, a, b in pairs)
    groups = {r["page_id"]: r["group_id"] for r in q["p5_page_groups"](spark, DATA).collect()}
    assert set(groups) == pages and all(groups[a] == groups[b] for t, a, b in pairs if t == "scraped_pages")
    facts = {r["fact_id"]: r["group_id"] for r in q["p5_fact_groups"](spark, DATA).collect()}
    assert set(facts) == {i for t, a, b in pairs if t == "facts" for i in (a, b)}


def test_products_agree_with_the_cases(spark):
    q = queries.queries()
    gone = {}
    for i, n in q["p1_found"](spark, DATA).collect():
        gone.setdefault(i, set()).add(n)
    assert {r["page_id"]: r["removed"] for r in q["p1_clean"](spark, DATA).collect() if r["removed"]} == {i: len(n) for i, n in gone.items()}
    assert {r["doc_id"] for r in q["p7_packs"](spark, DATA).where("n_pieces > 1").collect()} == {r[0] for r in q["p7_found"](spark, DATA).collect()}
    assert {r["page_id"] for r in q["p3_pieces"](spark, DATA).collect()} == {r[0] for r in q["p3_found"](spark, DATA).collect()}
    assert {r["doc_id"] for r in q["p9_shared"](spark, DATA).collect()} == {i for r in q["p9_found"](spark, DATA).collect() for i in r}
