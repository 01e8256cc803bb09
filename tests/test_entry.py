import os

import duckdb
import pytest

import __spark_entry__ as e
from quaestor.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_core_query_against_sql(spark, name):
    df = e.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.oracle_sql():
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(e.oracle_sql()[name])

    def canonical(rows, columns):
        order = sorted(range(len(columns)), key=lambda k: columns[k])
        return sorted(str([r[k] for k in order]) for r in rows)

    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(got, df.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert [r["rank"] for r in e.entry(spark).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
