import itertools
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from quaestor.llm import near_duplicates, spans
from quaestor.llm.components import components


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = rng.choice([[], ["neu" + str(rng.randrange(9999))]])
        words = words or ["x"]
    return words


def corpus(rng, n=120, size=(3, 40)):
    vocabulary = [f"w{k}" for k in range(400)] + ["the"] * 200
    texts = []
    while len(texts) < n:
        words = rng.choices(vocabulary, k=rng.randint(*size))
        texts += [" ".join(edited(rng, words, k)) for k in rng.choices([0, 0, 1, 2, 5, 9], k=rng.randint(1, 4))]
    return texts


@pytest.mark.parametrize("t", [Fraction(3, 4), Fraction(4, 5)])
def test_similar_pairs_against_brute_force(spark, t):
    rng = random.Random(7)
    texts = [*corpus(rng), None, "", "!!! ...", "ein zwei drei vier fünf", "FÜNF, vier! drei zwei-ein", "a b c d e"] + ["same words here for all rows"] * 20
    df = spark.createDataFrame([(i, x, 1, "q") for i, x in enumerate(texts)] + [(None, "same words here for all rows", 1, "q")], "fact_id long, fact string, n int, id string").repartition(5)
    got = sorted(tuple(r) for r in near_duplicates.similar_pairs(df, "fact_id", "fact", t).collect())
    sets = {i: set(re.findall(r"[^\W_]+", (x or "").lower())) for i, x in enumerate(texts)}
    sets = {i: s for i, s in sets.items() if len(s) >= 5}
    want = sorted((i, j) for i, j in itertools.combinations(sorted(sets), 2) if Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= t)
    assert got == want and len(want) > 200
    groups = {r["fact_id"]: r["group_id"] for r in near_duplicates.duplicate_groups(df, "fact_id", "fact", t).collect()}
    assert set(groups) == {i for p in want for i in p}
    assert all(groups[i] == groups[j] for i, j in want) and all(groups[i] <= i for i in groups)
    assert near_duplicates.similar_pairs(df.limit(0), "fact_id", "fact").collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    rng = random.Random(1)
    table = near_duplicates.pruning_table(0.75)
    agree = 0.75 + 0.25 / 16
    lost = 0
    for _ in range(20_000):
        d = n = 0
        for upto, most in table:
            d += sum(rng.random() > agree for _ in range(upto - n))
            n = upto
            if d > most:
                lost += 1
                break
    assert lost <= 8


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(64)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p if p[0] != p[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_spans(texts):
    seen = defaultdict(set)
    for i, x in texts:
        for p in range(len(x) - spans.MIN_SPAN + 1):
            seen[x[p : p + spans.MIN_SPAN]].add(i)
    pairs, chars = set(), defaultdict(set)
    for v in seen.values():
        pairs |= set(itertools.combinations(sorted(v), 2))
    for i, x in texts:
        for p in range(len(x) - spans.MIN_SPAN + 1):
            if len(seen[x[p : p + spans.MIN_SPAN]]) > 1:
                chars[i] |= set(range(p, p + spans.MIN_SPAN))
    return sorted(pairs), {i: len(c) for i, c in chars.items()}


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdeęß 😀\n") for _ in range(n))
    passages = [make(n) for n in (299, 300, 301, 350, 600, 2000)]
    texts = []
    for k in range(60):
        parts = [make(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), make(rng.randint(0, 200))]
        texts.append("".join(parts))
    texts += [texts[0]] * 3 + ["z" * 900, "z" * 700, "ab" * 400, "", "short"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, x, "q", 1) for i, x in rows] + [(100, None, "q", 1), (None, texts[1], "q", 1)], "doc_id long, text string, edge string, pos int").repartition(5)
    pairs, chars = brute_spans(rows)
    assert sorted(tuple(r) for r in spans.sharing_pairs(df).collect()) == pairs and len(pairs) > 100
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_characters(df).collect()}
    assert {i: n for i, n in got.items() if n} == chars
    assert spans.sharing_pairs(df.limit(0)).collect() == []


def test_long_span_behind_a_short_one_on_the_same_diagonal(spark):
    rng = random.Random(13)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for k in range(25):  # spans of 150 to 299 characters, each followed by another character, then 300 or more; the last pairs have no long one
        parts = [make(rng.randint(150, 299)) for _ in range(rng.randint(1, 3))] + [make(rng.randint(300, 700) if k < 20 else 299)] + [make(rng.randint(150, 299))]
        texts += ["0".join(parts), "1".join(parts)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs, _ = brute_spans(rows)
    assert sorted(tuple(r) for r in spans.sharing_pairs(df).collect()) == pairs and len(pairs) == 20
    twice = make(400) + "{}" + make(200) + "{}" + make(350)
    found, _ = spans.span_starts(spark.createDataFrame([(1, twice.format(0, 0)), (2, "x" + twice.format(1, 1))], "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 0, 1), (1, 2, 602, 603)]


def test_a_passage_of_half_the_texts_makes_rows_in_proportion(spark):
    rng = random.Random(17)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    licence = make(4000)
    rows, windows = {}, {}
    for n in (40, 80):
        texts = [(i, make(50) + licence[rng.randrange(1500) : 4000 - rng.randrange(1500)] + make(50) if i % 2 else make(800)) for i in range(n)]
        df = spark.createDataFrame(texts, "doc_id long, text string")
        found, _ = spans.span_starts(df)
        rows[n] = sorted((r["a"], r["b"]) for r in found.collect())
        long, _, spots = spans.repeated_edges(df, "doc_id", "text")
        places = spots.join(spans.path_heads(spots), "edge", "left_semi").groupBy("id").agg({"pos": "collect_list"}).toDF("id", "at")
        windows[n] = spans.windows_around(long, places).count()
        assert rows[n] == list(itertools.combinations(range(1, n, 2), 2))  # each pair once
    assert windows[80] < 3 * windows[40]


def test_anchors_do_not_depend_on_where_a_text_is_cut():
    rng = random.Random(12)
    text = "".join(rng.choice("abcd ") for _ in range(5000))
    at, h = spans.anchors(text)
    for step in (7, 300, 1000):
        other, g = spans.anchors(text, step)
        assert other.tolist() == at.tolist() and g.tolist() == h.tolist()
    assert max(b - a for a, b in zip(at, at[1:])) <= spans.WINDOW
