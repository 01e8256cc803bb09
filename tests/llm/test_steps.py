import os

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from quaestor.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_product_in_any_step(spark, name, monkeypatch):
    """Neither the result nor any table that is cut on the way comes from a cross join or from Python row by row."""
    plans = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(plan(self._df)), write(self, *a, **k))[1])
    plans.append(plan(queries.queries()[name](spark, DATA)))
    for text in plans:
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in text


@pytest.mark.parametrize("name", ["p3_found", "p3_pieces", "p4_found", "p4_main_text", "p6_found", "p6_kinds", "p8_found", "p8_leaks"])
def test_pages_and_searches_need_no_shuffle(spark, name):
    assert "Exchange" not in plan(queries.queries()[name](spark, DATA))


def test_scans_read_two_columns(spark):
    for name in ("p3_found", "p4_found", "p6_found"):
        assert "ReadSchema: struct<page_id:bigint,text:string>" in plan(queries.queries()[name](spark, DATA))
