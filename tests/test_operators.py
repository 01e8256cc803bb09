import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.config import config_for
from quaestor.operators import ann, embed, facts, prompt, relational, retrieve


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_config():
    assert not config_for("1").extract_with_model and config_for(2).extract_with_model
    assert config_for(3) == config_for(4) and config_for(3).crawl
    assert config_for(9).crawl and not config_for(9).extract_with_model
    with pytest.raises(ValueError):
        config_for("x")


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y"), ("a", 0, "z")], "k string, o int, v string")
    assert rows(relational.last_per_key(df, ["k"], ["o"]), "k") == [("a", 2, "x"), ("b", 1, "y")]
    assert rows(relational.last_per_key(df.limit(0), ["k"], ["o"])) == []


def test_lookup(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    side = spark.createDataFrame([("1a", "A"), ("1a", "A2"), ("2b", "B"), ("1d", None), ("2d", "D"), (None, "N")], "file string, source_url string")
    found = relational.lookup_source(texts, side, F.concat(F.lit("1"), "file"), F.concat(F.lit("2"), "file"), F.col("file"))
    assert rows(found, "file") == [("a", "A2"), ("b", "B"), ("c", "c"), ("d", None)]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_ids_are_contiguous_and_ordered(spark, n):
    values = list(range(n))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = rows(relational.numbered(df, [F.col("v")], "n", base=10), "v")
    assert got == [(v, v + 11) for v in range(n)]
    assert {r[1] for r in rows(relational.assign_ids(df, [F.col("v")]))} == {f"ids_{k}" for k in range(1, n + 1)}


def test_limit_per_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "g string, o int")
    assert rows(relational.limit_per_group(df, "g", ["o"], 2), "g", "o") == [("a", 1), ("a", 2), ("b", 9)]


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).astype(np.float32)
    vectors[7] = vectors[3]  # a tie
    vectors[9] = 0
    data = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(100, None)]
    index = spark.createDataFrame(data, "id long, embedding array<float>").repartition(5)
    queries = index.where("id % 10 = 3 or id = 9").select(F.col("id").alias("query_id"), "embedding")
    got = rows(retrieve.top_k_batch(queries, index, 5), "query_id", "rank")
    want = []
    for q in range(3, 60, 10):
        x = vectors.astype(float)
        sims = [(round(float(x[q] @ x[i]) / (np.linalg.norm(x[q]) * np.linalg.norm(x[i])), 6), i) for i in range(60) if i != 9]
        want += [(q, i, s, r) for r, (s, i) in enumerate(sorted(sims, key=lambda p: (-p[0], p[1]))[:5], 1)]
    assert got == want
    single = rows(retrieve.top_k_single(index, vectors[3].tolist(), 5).select("rank", "id", "sim"), "rank")
    assert single == [(r, i, s) for q, i, s, r in want if q == 3]
    assert single[0][1:] == (3, 1.0) and single[1][1:] == (7, 1.0)
    assert rows(retrieve.top_k_batch(queries.limit(0), index)) == rows(retrieve.top_k_batch(queries, index.limit(0))) == []
    assert len(rows(retrieve.top_k_batch(queries.where("query_id = 3"), index.where("id < 2"), 5))) == 2


def test_context_and_answers(spark):
    hits = spark.createDataFrame([(1, 2, "b", "u"), (1, 1, "a\nx", "u"), (1, 3, None, None)], "query_id long, rank int, text string, source_url string")
    context = rows(prompt.labelled_context(hits))
    assert context == [(1, "[S1]\na\nx\n\n---\n\n[S2]\nb\n\n---\n\n[S3]\n", ["u", "u", None])]
    queries = spark.createDataFrame([(1, "q", "f", "2"), (2, "r", None, None)], "query_id long, query string, field_of_study string, semester string")
    assert rows(prompt.respond(queries, hits, "none", "sorry"), "query_id") == [(1, "a", ["u", "u", None]), (2, "none", [])]

    class Broken:
        def answer(self, prompts):
            raise RuntimeError

    assert rows(prompt.respond(queries, hits, "none", "sorry", make=Broken), "query_id")[0][1] == "sorry"


def test_student_clause(spark):
    df = spark.createDataFrame([("f", "2"), ("f", None), ("f", ""), (None, "2"), ("", "2"), (None, None)], "f string, s string")
    got = [r[0] for r in df.select(prompt.student_clause(F.col("f"), F.col("s"))).collect()]
    assert got == ["The user studies f, term 2.", "The user studies f.", "The user studies f.", "", "", ""]


def test_shown_answer_and_history(spark):
    df = spark.createDataFrame([("a", ["x", "y", "x", None]), ("b", []), ("c", None)], "a string, s array<string>")
    assert [r[0] for r in df.select(prompt.shown_answer(F.col("a"), F.col("s"), "S:")).collect()] == ["a\n\nS:\n- x\n- y", "b", "c"]
    turns = spark.createDataFrame([(1, 2, "assistant", "B"), (1, 1, "user", "A"), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    assert rows(prompt.history(turns)) == [(1, 3, "user: A\nassistant: B\nuser: ")]


def test_hash_embedding_equals_the_stand_in(spark):
    texts = ["Ala ma kota, kota Ali", "x", "", None, "Zażółć gęślą jaźń 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows(embed.hash_embedding(df, "i", "t"), "i", "bucket")
    dense = embed.HashEmbedder().embed([t or "" for t in texts])
    want = [(i, b, round(float(v), 6)) for i, row in enumerate(dense) for b, v in enumerate(row) if v]
    assert [(i, b) for i, b, _ in got] == [(i, b) for i, b, _ in want]
    assert all(math.isclose(x[2], y[2], abs_tol=1e-6) for x, y in zip(got, want))
    assert zlib.crc32(b"x") % 64 == next(b for i, b, _ in got if i == 1)
    vectors = df.select(embed.embed_column(F.col("t")).alias("v")).collect()
    assert len(vectors) == 5 and all(len(r["v"]) == 64 for r in vectors)


def test_fact_files(spark):
    files = [
        ("ok", '[{"source": "s", "fact": "f"}, {"fact": "g"}, {"source": null, "fact": "h"}, {"fact": ""}, {"fact": " "}, {"source": "s"}]'),
        ("odd", '[{"fact": "a"}, {"fact": "b"}, 3, {"fact": "c"}]'),
        ("object", "{}"),
        ("bad", "[{]"),
        ("null", None),
        ("empty", "[]"),
    ]
    df = spark.createDataFrame(files, "file string, text string")
    good = [("ok", 0, "s", "f"), ("ok", 1, "unknown", "g"), ("ok", 2, None, "h"), ("ok", 4, "unknown", " ")]
    assert rows(facts.facts_of_files(df), "file", "pos") == good
    assert rows(facts.facts_of_files(df, keep_prefix=True), "file", "pos") == [("odd", 0, "unknown", "a"), ("odd", 1, "unknown", "b"), *good]


def test_extraction_errors(spark):
    class Model:
        def extract(self, chunk):
            if "boom" in chunk:
                raise RuntimeError
            return "oops" if "bad" in chunk else '```json\n["' + chunk + '"]\n```'

    df = spark.createDataFrame([("a", "onetwobad"), ("b", "oneboo"), ("c", "oneboom"), ("d", ""), ("e", None)], "file string, text string")
    parts = spark.createDataFrame([("a", "onetwobad"), ("b", "oneboo"), ("d", ""), ("e", None)], "file string, text string")
    got = rows(facts.extracted_facts(parts, "file", "text", 3, Model), "file", "chunk_no")
    assert [(f, n, x) for f, n, _, x in got] == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "one"), ("b", 1, "boo")]
    whole = rows(facts.extracted_facts(df, "file", "text", 100, Model), "file")
    assert [f for f, *_ in whole] == ["b"]


def test_passthrough(spark):
    df = spark.createDataFrame([("a", " x\n"), ("b", " "), ("c", None)], "file string, text string")
    assert rows(facts.passthrough_facts(df, "file", "text"), "file") == [("a", "x"), ("b", "")]
    assert rows(facts.truthy_facts(spark.createDataFrame([("",), (" ",), (None,), ("a",)], "fact string"))) == [(" ",), ("a",)]


def test_append_turns(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    queries = spark.createDataFrame([(1, "c"), (2, "d"), (3, "e")], "conv_id long, query string")
    responses = spark.createDataFrame([(1, "C"), (2, None)], "conv_id long, answer string")
    got = rows(prompt.append_turns(turns, queries, responses), "conv_id", "turn")
    assert got == [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "assistant", "C"), (2, 1, "user", "d"), (3, 1, "user", "e")]


def test_cli():
    from quaestor import cli

    assert list(cli.questions(["  a ", "", "b\n", "q", "c"])) == ["a", None, "b"]
    assert list(cli.questions(["Q"])) == list(cli.questions([])) == []


def test_log_levels(tmp_path):
    import logging

    from quaestor import cli

    assert cli.log_level("debug") == logging.DEBUG and cli.log_level("nonsense") == cli.log_level(None) == logging.INFO
    log = cli.setup_logging(str(tmp_path / "x" / "log.txt"), "warning")
    log.warning("here")
    for h in log.handlers:
        h.flush()
    assert "here" in (tmp_path / "x" / "log.txt").read_text()


def test_approximate_top_k(spark):
    rng = np.random.default_rng(5)
    groups = rng.normal(size=(20, 16))
    vectors = (groups[rng.integers(0, 20, 1500)] + 0.6 * rng.normal(size=(1500, 16))).astype(np.float32)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(9998, None), (9999, [0.0] * 16)], "id long, embedding array<float>").repartition(6)
    queries = index.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    centres = ann.fit_centres(index, 16, sample_rows=400)
    celled = ann.assign_cells(index, centres)
    assert celled.count() == 1500
    found = ann.top_k_cells(queries, celled, centres, 5, probes=4)
    exact = retrieve.top_k_batch(queries, index, 5)
    assert ann.recall(exact, found) >= 0.9
    assert ann.recall(exact, ann.top_k_cells(queries, celled, centres, 5, probes=16)) == 1
    none = ann.fit_centres(index.limit(0), 16)
    assert ann.top_k_cells(queries, ann.assign_cells(index, none), none).collect() == []
