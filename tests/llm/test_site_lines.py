import random
from collections import defaultdict

import numpy as np
import pytest

from quaestor.llm import site_lines
from quaestor.llm.common import site_of


def brute(rows, min_docs=5):
    where, found = defaultdict(set), []
    for i, url, text in rows:
        if i is None or url is None or text is None:
            continue
        site = url.split("//", 1)[1].split("/")[0].lower().removeprefix("www.").split(":")[0]
        for n, line in enumerate(text.split("\n"), 1):
            key = "".join(c for c in line.lower() if c.isalpha())
            if key:
                where[site, key].add(i)
                found.append((i, n, (site, key)))
    return sorted((i, n) for i, n, k in found if len(where[k]) >= min_docs)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["Menu", "* MENU 12", "", "---", "żółw", "A b", "ab!", *(f"line {chr(97 + k)}" for k in range(12)), "\r"]
    rows = [(i, rng.choice(["http://www.A.example:80/x", "https://a.example/y", "http://b.example", None]), rng.choice([None, "", "\n".join(rng.choices(lines, k=rng.randint(1, 30)))])) for i in range(120)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, text string, id int, h string").repartition(6)
    got = sorted(tuple(r) for r in site_lines.repeated_lines(df).collect())
    assert got == brute(rows)
    gone = defaultdict(set)
    for i, n in got:
        gone[i].add(n)
    clean = {r["page_id"]: r for r in site_lines.without_repeated_lines(df).collect()}
    assert len(clean) == len(rows)
    for i, _, text in rows:
        want = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n"), 1) if n not in gone[i])
        assert clean[i]["text"] == want and clean[i]["removed"] == len(gone[i])


def test_edges(spark):
    schema = "page_id long, url string, text string"
    assert site_lines.repeated_lines(spark.createDataFrame([], schema)).collect() == []
    many = "\n".join(f"{w} {w}" for w in ("alpha", "beta", "gamma") * 5000)
    rows = [(i, "http://x.example/", many) for i in range(5)] + [(None, "http://x.example/", many)]
    assert site_lines.repeated_lines(spark.createDataFrame(rows, schema)).count() == 5 * 15000
    assert site_lines.repeated_lines(spark.createDataFrame(rows[1:], schema)).count() == 0


def test_repeated_rows_are_one_document(spark):
    rows = [(min(i, 3), "http://x.example/", "one\ntwo") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, text string")
    assert site_lines.repeated_lines(df).count() == 0
    assert site_lines.repeated_lines(df.union(df.selectExpr("page_id + 10", "url", "text"))).count() == 24


def test_each_of_the_rows_with_one_id_loses_its_own_lines(spark):
    rows = [(9, "http://x.example/", "shared\nmine"), (9, "http://x.example/", "other\nshared")] + [(i, "http://x.example/", f"{chr(97 + i)} only\nshared") for i in range(4)]
    clean = site_lines.without_repeated_lines(spark.createDataFrame(rows, "page_id long, url string, text string")).collect()
    assert sorted((r["text"], r["removed"]) for r in clean if r["page_id"] == 9) == [("mine", 1), ("other", 1)]


def blocks_of(spark, texts):
    df = spark.createDataFrame([(i, "http://x.example/", t) for i, t in enumerate(texts)], "page_id long, url string, text string")
    return df, sorted((r["n_lines"], r["docs"]) for r in site_lines.block_report(df).collect())


def test_blocks(spark):
    df, found = blocks_of(spark, ["one\ntwo\nthree\nown" + "abcdefghij"[i] + "\none\ntwo" for i in range(5)])
    assert found == [(2, 5), (3, 5)]
    name = lambda k: "line " + chr(97 + k // 26) + chr(97 + k % 26)
    long = [name(k) for k in range(50)]
    _, found = blocks_of(spark, ["\n".join(["own" + "abcdef"[i], *long, "end" + "abcdef"[i]]) for i in range(6)])
    assert found == [(50, 6)]  # one block, and not many short ones
    # five documents go on where eight agree, and one more starts later and ends earlier
    texts = ["\n".join(long[:20] + ["x" + "abcdefg"[i]]) for i in range(3)] + ["\n".join(long[:40] + ["y" + "abcdefg"[i]]) for i in range(5)] + ["\n".join(["z"] + long[10:20])]
    _, found = blocks_of(spark, texts)
    assert found == [(10, 9), (20, 8), (40, 5)]


def test_only_whole_blocks_decide(spark, monkeypatch):
    """Lines inside a block are deleted because the block is: without the blocks of more than one line, most of them stay."""
    texts = ["one\ntwo\nthree\nown" + "abcde"[i] for i in range(5)]
    df, _ = blocks_of(spark, texts)
    assert site_lines.repeated_lines(df).count() == 15
    whole = site_lines.repeated_blocks
    monkeypatch.setattr(site_lines, "repeated_blocks", lambda *a: whole(*a).where("k = 1"))
    assert site_lines.repeated_lines(df).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_previous_factors_against_brute_force(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 7, 30, 60):
        s = [rng.randrange(1 + n // 6) for _ in range(n)]
        best = []
        for i in range(n):
            most = 0
            for j in range(i):
                k = 0
                while i + k < n and s[i + k] == s[j + k]:
                    k += 1
                most = max(most, k)
            best.append(most)
        assert site_lines.previous_factors(np.array(s, np.int64)).tolist() == best


def test_sites(spark):
    from pyspark.sql import functions as F

    urls = {"HTTPS://WWW.A.example:8080/x?y#z": "a.example", "http://u:p@b.example": "b.example", "c.example/x": "c.example", "//d.example/": "d.example", "": None, None: None, "/x": None, "http://wwww.e.example": "wwww.e.example"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(site_of(F.col("u"))).collect()] == list(urls.values())
