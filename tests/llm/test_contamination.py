import random

from quaestor.llm.contamination import Matcher, _blocks, fold_words, leaks, myers


def test_folding():
    assert fold_words("Za\u017c\u00f3\u0142\u0107 g\u0119\u015bl\u0105") == ["zazolc", "gesla"]
    assert fold_words("a\u00adb c\u200bd <b>x</b>y<br>z [l](http://a.b) **STRASSE** Stra\u00dfe _q_ e\u0301") == ["ab", "cd", "xy", "z", "l", "strasse", "strasse", "q", "e"]
    assert fold_words("") == []


def test_myers_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(2000):
        p, t = rng.choices("abc", k=rng.randint(1, 13)), rng.choices("abc", k=rng.randint(0, 16))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            cur = [i]
            for j, y in enumerate(t, 1):
                cur.append(min(row[j] + 1, cur[j - 1] + 1, row[j - 1] + (x != y)))
            row = cur
        assert myers(p, t) == min(row)


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(50)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 30))), rng.choice([None, "", " ".join(rng.choices(vocabulary, k=10))])) for i in range(40)]
    words = {i: fold_words(" ".join(filter(None, (q, a)))) for i, q, a in items}
    docs = [(900, None), (901, ""), (902, "w1 " * 20_000)]
    for d in range(150):
        text = rng.choices(vocabulary, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            w = words[rng.randrange(40)]
            at = rng.randint(0, len(w) - 1)
            part = w[at : at + rng.randint(8, 20)]
            if rng.random() < 0.4 and part:
                part[rng.randrange(len(part))] = "other"
            text += part + rng.choices(vocabulary, k=5)
        docs.append((d, rng.choice([" ", "\n", ", ", "\u200b ", " **"]).join(text).upper()))
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, run int").repartition(4)
    tests = spark.createDataFrame(items, "item_id long, question string, answer string")
    got = leaks(frame, tests).collect()
    exact, near = set(), set()
    for d, text in docs:
        w = fold_words(text or "")
        for i, item in words.items():
            windows = [item[k : k + 12] for k in range(len(item) - 11)]
            inside = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
            if any(tuple(x) in inside for x in windows):
                exact.add((d, i))
            if d < 900 and windows and min(myers(x, w) for x in windows) <= 1:
                near.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in got if r["run"] >= 12} == exact and len(exact) > 20
    assert {(r["doc_id"], r["item_id"]) for r in got} == near | exact and len(near) > len(exact)
    assert leaks(frame.limit(0), tests).collect() == leaks(frame, tests.limit(0)).collect() == []


def test_longest_run_behind_a_shorter_one_on_the_same_diagonal():
    item = [f"w{k}" for k in range(60)]
    matcher = Matcher([(1, item)], 12, 1)
    for at, longest in ((12, 47), (47, 47), (25, 34), (11, 48)):
        text = item[:at] + ["other"] + item[at + 1 :]
        assert matcher.leaks(" ".join(["x", *text, "y"])) == [(1, 0, longest)]
    assert matcher.leaks(" ".join(item[:12] + ["other"] + item[13:53] + ["z"] + item[54:])) == [(1, 0, 40)]


def test_blocks_lose_nothing():
    items = [(k, ["w"] * k) for k in range(10)]
    blocks = list(_blocks(iter(items), 12))
    assert [x for b in blocks for x in b] == items and all(sum(len(w) for _, w in b) <= 12 or len(b) == 1 for b in blocks)
    assert Matcher([], 12, 1).leaks("a b c") == []
