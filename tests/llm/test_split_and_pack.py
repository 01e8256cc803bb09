import random
import re
from collections import Counter, defaultdict

import pytest

from quaestor.llm.packing import best_packing, pack, pack_histogram
from quaestor.llm.split import cut_kinds, split_texts

LIMIT, OVERLAP = 100, 20


def sample(rng):
    parts = []
    while sum(map(len, parts)) < rng.choice([0, 50, 400, 2000]):
        parts.append(rng.choice(["word ", "zażółć ", "😀", "End. ", "\n", "\r\n\r\n", "\n\n", " ", "x" * rng.randint(1, 130), "x" * 101 + " "]))
    return "".join(parts)


def test_round_trip(spark):
    rng = random.Random(2)
    texts = [None, "", "a" * LIMIT, "a" * (LIMIT + 1), " " * 500, "a " + "b" * 300, *(sample(rng) for _ in range(300))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "page_id long, text string, piece int")
    pieces = defaultdict(list)
    for r in split_texts(df, limit=LIMIT, overlap=OVERLAP).collect():
        pieces[r["page_id"]].append(r)
    kinds = dict(cut_kinds(df, limit=LIMIT, overlap=OVERLAP).collect())
    for i, text in enumerate(texts):
        if text is None or len(text) <= LIMIT:
            assert i not in pieces and i not in kinds
            continue
        got = sorted(pieces[i], key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in got] == list(range(1, len(got) + 1))
        whole = ""
        for k, r in enumerate(got):
            assert 0 < len(r["piece"]) <= LIMIT
            assert text[r["start"] :].startswith(r["piece"])
            if k:
                assert r["piece"].startswith(got[k - 1]["piece"][-OVERLAP:])
            whole = whole[: r["start"]] + r["piece"]
        assert whole == text
        assert kinds[i] == ("forced" if re.search(rf"\S{{{LIMIT + 1}}}", text) else "natural")


def test_boundaries(spark):
    text = "a" * 60 + ". " + "b" * 20 + "\n\n" + "c" * 10 + "\n" + "d" * 3 + " " + "e" * 60
    df = spark.createDataFrame([(1, text)], "page_id long, text string")
    got = [r["piece"] for r in split_texts(df, limit=LIMIT, overlap=OVERLAP).orderBy("piece_no").collect()]
    assert got[0] == text[:84] and got[1] == text[64:]
    assert split_texts(df.limit(0)).collect() == []


@pytest.mark.parametrize("largest", [True, False])
def test_histogram_packing(largest):
    rng = random.Random(3)
    for _ in range(100):
        capacity = rng.randint(1, 60)
        histogram = dict(Counter(rng.choices(range(1, capacity + 1), k=rng.randint(0, 200))))
        packs = pack_histogram(histogram, capacity, largest)
        assert all(n > 0 and 0 < sum(p) <= capacity for n, p in packs)
        back = Counter()
        for n, p in packs:
            for x in p:
                back[x] += n
        assert back == Counter(histogram)
        total = sum(k * n for k, n in histogram.items())
        assert sum(n for n, _ in best_packing(histogram, capacity)) <= 1.7 * -(-total // capacity) + 1
    assert best_packing({3: 10**12, 7: 10**12}, 10) == [(10**12, [7, 3])]
    with pytest.raises(ValueError):
        pack_histogram({0: 1}, 5)


def test_pack(spark):
    rng = random.Random(4)
    texts = ["w " * rng.choice([1, 3, 9, 10, 11, 25, 40]) for _ in range(400)] + ["same same"] * 300 + [None, "", "  ", "a_b,, c…", "e\u0301"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "x y", 7), (0, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    got = pack(df, capacity=10).collect()
    load, pieces = Counter(), Counter()
    for r in got:
        load[r["container"]] += r["size"]
        pieces[r["doc_id"]] += r["size"]
        assert 1 <= r["piece_no"] <= r["n_pieces"] and r["n_pieces"] == -(-r["n_tokens"] // 10)
    count = lambda t: len(re.findall(r"\w+|[^\w\s]+", t))
    want = Counter()
    for i, t, _ in rows:
        if t is not None:
            want[i] += count(t)
    assert pieces == +want
    assert max(load.values()) <= 10 and set(load) == set(range(len(load)))
    assert len(load) <= 1.1 * sum(load.values()) / 10 + 2
    assert pack(df.limit(0)).collect() == []
