import pytest
from pyspark.sql import functions as F

from quaestor.functions import json, text


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_markers(spark):
    got = column(spark, ["a##b##c", "##b", "none", "", None, "b##"], lambda t: text.after_first(t, "##"))
    assert got == ["b##c", "b", "none", "", None, ""]
    got = column(spark, ["a##b##c", "##b", "none", "", None, "b##"], lambda t: text.before_first(t, "##"))
    assert got == ["a", "", "none", "", None, "b"]
    assert column(spark, ["x!y?z", "x?y!z", "a.*b"], lambda t: text.between_markers(t, "!", "?")) == ["y", "z", "a.*b"]


def test_names(spark):
    urls = ["https://a.example/b/", "http://a.example/b", "/x/", None, "https://a.example/?q=1"]
    assert column(spark, urls, text.safe_name) == ["a.example_b", "http:__a.example_b", "x", None, "a.example_?q=1"]
    assert column(spark, ["x.txt.docx.txt", "x", "x.txt"], text.facts_name) == ["x.txt.docx_facts.json", "x_facts.json", "x_facts.json"]
    assert column(spark, ["a.txt.txt"], lambda t: text.swap_suffix(t, ".txt", ".json")) == ["a.json.json"]


def test_strip_is_the_strip_of_python(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert len(spaces) == 29
    values = [s + "a" + t + "b" + s for s in spaces for t in ("", " ")] + spaces + ["​ a", None]
    assert column(spark, values, text.strip) == [None if v is None else v.strip() for v in values]


@pytest.mark.parametrize("size", [1, 3, 15000])
def test_chunks(spark, size):
    values = ["", None, "a" * size, "a" * size + "b", "😀" * (size + 1)]
    got = column(spark, values, lambda t: text.chunks(t, size))
    want = [[(i, (v or "")[i * size : (i + 1) * size]) for i in range((len(v or "") + size - 1) // size)] for v in values]
    assert [[tuple(c) for c in x] for x in got] == want


def test_code_fence(spark):
    fence = "`" * 3
    assert column(spark, [f"{fence}json\n[1]\n{fence}", f"x{fence}", None], text.without_code_fence) == ["\n[1]\n", f"x{fence}", None]


def test_strict_json_lists(spark):
    values = ['["a"]', '["a", 1, null, {"b": 2}]', '{"a": 1}', "['a']", '["a"] x', "[NaN]", "", None, "[]"]
    assert column(spark, values, json.parse_list) == [["a"], ["a", "1", None, '{"b": 2}'], None, None, None, ["NaN"], None, None, []]


def test_field_default(spark):
    assert column(spark, ['{"k": 1}', '{"j": 1}', None], lambda t: json.field(t, "k", "d")) == ["1", "d", "d"]
    assert column(spark, ['{"k": null}', '{"k": "x"}', "[1]"], lambda t: json.field(t, "k", "d")) == [None, "x", "d"]


def test_markdown_row(spark):
    df = spark.createDataFrame([(["a", None, "c"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(text.markdown_row(F.col("c"))).collect()] == ["| a |  | c |", "|  |"]


def test_arrays(spark):
    from quaestor.functions.arrays import slices, zip_shortest

    df = spark.createDataFrame([([1, 2, 3], ["a", "b"]), ([], ["a"]), (None, ["a"])], "a array<int>, b array<string>")
    got = df.select(zip_shortest(F.col("a"), F.col("b")).alias("z"), slices(F.col("a"), 2).alias("s")).collect()
    assert [None if r["z"] is None else [tuple(x) for x in r["z"]] for r in got] == [[(1, "a"), (2, "b")], [], None]
    assert [r["s"] for r in got] == [[[1, 2], [3]], [], []]
