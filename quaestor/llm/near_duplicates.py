"""Near-duplicate records: exact candidates by prefix filtering, Bayesian pruning with MinHash, exact verification.

* Each record is its set of distinct words.  Equal sets are one class, represented by the smallest id.
* Words are ordered from rare to frequent.  Only frequent words need a known frequency: those in at least
  ``HEAVY`` of the documents, at most ``mean words / HEAVY`` of them, are broadcast.
* Take a pair x, y with x the smaller set, ``a`` words only in x and ``b`` only in y.  Threshold and sizes
  bound a + b, and b - a is known, so the first word in common is among the first a + 1 of x and the first
  b + 1 of y: a join on these words finds *every* pair.  Words of one record only are dropped before it.
* A word with more than ``SPLIT`` records is split by the sizes of both sets.  Its place in x tells how large
  y can be, its place in y how small x must be, so x stands under its own size class and each one possible
  for y, and y the other way round: what meets under a hot word are pairs that may still reach t.
* BayesLSH: of each candidate, ``BITS``-bit MinHash values are compared 16 at a time, and it is dropped as
  soon as the posterior probability that its similarity reaches t is below ``tolerance``; 0 drops none.
* What is left is verified on the 64-bit hashes of the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.plans.cut import cut, sized

HEAVY = 0.001
TOLERANCE = 1e-5
MIN_WORDS = 5
#: Records under one word from which on it is split by size classes, of which there are ``CLASSES`` per factor e.
SPLIT = 64
CLASSES = 20
SIGNATURE = 64
BITS = 4
_STEP = 16
_SIGS = [f"sig_{k}" for k in range(BITS)]
#: Multipliers of the hash functions, from a fixed rule.
_A = (np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(text: str) -> set[str]:
    """Distinct words: maximal runs of letters or digits, lower-cased."""
    return set(_word_pattern().findall(text.lower()))


_PATTERN = None


def _word_pattern():
    global _PATTERN
    if _PATTERN is None:
        import re

        _PATTERN = re.compile(r"[^\W_]+")
    return _PATTERN


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of this partition's documents, under the empty word, and of each word that at least HEAVY / 2 of them hold.

    What a word has in partitions that leave it out adds up to less than HEAVY / 2 of all documents, so a
    word that HEAVY of all documents hold keeps a sum of at least HEAVY / 2.
    """
    counts: dict[str, int] = {}
    n = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n += 1
            for w in words_of(text):
                counts[w] = counts.get(w, 0) + 1
        if len(counts) > 1_000_000:  # lossy counting: words this rare so far cannot be heavy by more than the slack of HEAVY / 2
            floor = n * HEAVY / 2
            counts = {w: k for w, k in counts.items() if k >= floor}
    kept = [("", n), *((w, k) for w, k in counts.items() if k >= max(2, n * HEAVY / 2))]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([k for _, k in kept], pa.int64())], ["word", "n"])


def heavy_words(texts: DataFrame) -> list[str]:
    """The frequent words from the least to the most frequent; at most ``2 * mean words / HEAVY`` of them."""
    counts = cut(texts.select("text").mapInArrow(_local_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    heavy = counts.where((F.col("word") != "") & (F.col("n") >= total * HEAVY / 2)).collect()
    return [r["word"] for r in sorted(heavy, key=lambda r: (r["n"], r["word"]))]


def signatures(texts: DataFrame) -> DataFrame:
    """``(id, n, set_a, set_b, sig_0 .. sig_3, words)``: size, two hashes of the word set, MinHash values bit by bit, and the words' hashes from rare to frequent."""
    heavy = texts.sparkSession.sparkContext.broadcast(heavy_words(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        known = np.array([digest(w) for w in heavy.value], np.uint64)
        by_hash = np.argsort(known)
        known = known[by_hash]
        weights = np.uint64(1) << np.arange(SIGNATURE, dtype=np.uint64)
        for batch in batches:
            ids, sizes, a, b, lists = [], [], [], [], []
            sigs: list[list[int]] = [[] for _ in range(BITS)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) < MIN_WORDS:
                    continue
                h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
                h.sort()
                least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(h), 512):
                    x = _A[:, None] * h[at : at + 512]
                    x ^= x >> np.uint64(32)
                    np.minimum(least, (x * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1), out=least)
                mixed = h * np.uint64(0x94D049BB133111EB)
                ids.append(i), sizes.append(len(h))
                a.append(int(h.sum().astype(np.int64))), b.append(int((mixed ^ (mixed >> np.uint64(31))).sum().astype(np.int64)))
                for k in range(BITS):
                    sigs[k].append(int((((least >> np.uint64(17 + k)) & np.uint64(1)) * weights).sum().astype(np.int64)))
                lists.append(h[np.argsort(_ranks(h, known, by_hash), kind="stable")].astype(np.int64))
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            words_column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array(x, pa.int64()) for x in sigs), words_column], ["id", "n", "set_a", "set_b", *_SIGS, "words"])

    return texts.select("id", "text").mapInArrow(run, f"id long, n int, set_a long, set_b long, {', '.join(f'{c} long' for c in _SIGS)}, words array<long>")


def _ranks(h: np.ndarray, known: np.ndarray, by_hash: np.ndarray) -> np.ndarray:
    """The place of each word among the frequent ones, from 1; 0 for all others."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, by_hash[at] + 1, 0)


def pruning_table(t: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``[(compared, most_differences)]``: after so many values, more differences than that end the comparison.

    Two values agree with probability J + (1 - J) / 2**BITS.  With a uniform prior on J, the posterior
    probability of J >= t is the share of the likelihood above t.
    """
    j = (np.arange(4000) + 0.5) / 4000
    agree = j + (1 - j) / 2**BITS
    out = []
    for n in range(_STEP, SIGNATURE + 1, _STEP):
        most = -1
        for d in range(n + 1):
            like = agree ** (n - d) * (1 - agree) ** d
            if like[j >= t].sum() / like.sum() < tolerance:
                break
            most = d
        out.append((n, most))
    return out


def _promising(t: float, tolerance: float) -> Column:
    """The incremental comparison of x and y as one condition; AND stops at the first step that fails."""
    differing = F.col("x.sig_0").bitwiseXOR(F.col("y.sig_0"))
    for c in _SIGS[1:]:
        differing = differing.bitwiseOR(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    cond = F.lit(True)
    for n, most in pruning_table(t, tolerance):
        mask = (1 << n) - 1 if n < 64 else -1
        cond = cond & (F.bit_count(differing.bitwiseAND(F.lit(mask).cast("long"))) <= most)
    return cond


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * CLASSES).cast("int")


def prefixes(rows: DataFrame, t: Fraction) -> DataFrame:
    """``(word, id, n, pos, smaller, split)``: the rarest words of each record of ``rows (id, n, words)`` that another one has among its own.

    As many as a partner down to the size t * n calls for; ``smaller`` marks those that count while the
    record is the smaller one of a pair, ``split`` words with more than ``SPLIT`` records.
    """
    p, q = t.numerator, t.denominator
    least = F.expr(f"cast((cast(n as long) * {p} + {q - 1}) div {q} as int)")  # the smallest partner
    flat = rows.select("id", "n", F.posexplode(F.slice("words", F.lit(1), F.col("n") - least + 1)).alias("pos", "word"))
    flat = flat.withColumn("smaller", F.expr(f"pos <= 2 * cast(n as long) * {q - p} div {p + q} div 2"))
    many = flat.groupBy("word").agg(F.count(F.lit(1)).alias("k"), F.max("smaller").alias("any")).where("k > 1 and any")
    return flat.join(many.select("word", (F.col("k") > SPLIT).alias("split")), "word")


def candidates(rows: DataFrame, t: Fraction) -> DataFrame:
    """``(a, b)``: all pairs of ``rows (id, n, words)`` whose first common words stand where sizes and t allow."""
    p, q = t.numerator, t.denominator
    s = (q - p) / (p + q)
    flat = cut(prefixes(rows, t))
    n, own = F.col("n"), _size_class(F.col("n"))
    limit = F.floor((n * (1 + s) - 2 * F.col("pos")) / (1 - s) + 1e-6)  # how large the other set can be
    whole = F.array(F.xxhash64("word"))

    def keys(low: Column, high: Column, key) -> Column:
        classes = F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.explode(F.when(F.col("split"), F.transform(classes, key)).otherwise(whole)).alias("key")

    larger = keys(own, _size_class(F.least(limit, F.floor(n * q / p + 1e-6))), lambda c: F.xxhash64(F.col("word"), own, c))
    lesser = keys(_size_class(F.ceil(n * p / q - 1e-6)), _size_class(F.least(limit, n)), lambda c: F.xxhash64(F.col("word"), c, own))
    x, y = flat.where("smaller").select("id", "n", "pos", larger).alias("x"), flat.select("id", "n", "pos", lesser).alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    ahead = (nx < ny) | ((nx == ny) & (F.col("x.id") < F.col("y.id")))
    sizes = nx.cast("long") * q >= ny.cast("long") * p
    apart = F.expr(f"cast(x.n + y.n as long) * {q - p} div {p + q}")  # a + b at most, while b - a = ny - nx
    near = (2 * F.col("x.pos") <= apart - ny + nx) & (2 * F.col("y.pos") <= apart + ny - nx)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & ahead & sizes & near)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def promising(pairs: DataFrame, rows: DataFrame, t: Fraction, tolerance: float) -> DataFrame:
    """Those of ``pairs (a, b)`` that the comparison of MinHash values does not rule out."""
    if not tolerance:
        return pairs
    x = rows.select(F.col("id").alias("a"), *_SIGS).alias("x")
    y = rows.select(F.col("id").alias("b"), *_SIGS).alias("y")
    return pairs.join(x, "a").join(y, "b").where(_promising(float(t), tolerance)).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, t: Fraction) -> DataFrame:
    """Those of ``pairs (a, b)`` whose words in common are at least t of their union."""
    p, q = t.numerator, t.denominator
    ends = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    needed = cut(rows.select("id", "n", "words").join(sized(ends), "id", "left_semi"))
    x, y = needed.toDF("a", "n_a", "words_a"), needed.toDF("b", "n_b", "words_b")
    common = F.size(F.array_intersect("words_a", "words_b"))
    return pairs.join(x, "a").join(y, "b").where(common * q >= (F.col("n_a") + F.col("n_b") - common) * p).select("a", "b")


def similar_sets(df: DataFrame, id_col: str, text_col: str, t: Fraction = Fraction(3, 4), tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """``(pairs, classes)``: ``(a, b)`` between representatives with similarity >= t, and ``(id, rep)`` of word sets that occur more than once.

    Null ids, null texts and texts with fewer than ``MIN_WORDS`` distinct words take no part.  A pair with
    similarity t is lost with a probability of about ``5 * tolerance``; a tolerance of 0 loses none.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = cut(signatures(texts))
    key = ["n", "set_a", "set_b"]
    many = rows.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").select(*key, "rep")
    classes = cut(rows.select("id", *key).join(many, key).select("id", "rep"))
    copies = cut(classes.where("id <> rep").select("id"))
    found = cut(candidates(rows.join(sized(copies), "id", "left_anti"), t))
    return cut(verified(cut(promising(found, rows, t, tolerance)), rows, t)), classes


def similar_pairs(df: DataFrame, id_col: str, text_col: str, t: Fraction = Fraction(3, 4), tolerance: float = TOLERANCE) -> DataFrame:
    """``(a, b)``, a < b: all pairs of records, copies included, whose word sets have a Jaccard similarity of at least t.

    Null ids, null texts and texts with fewer than ``MIN_WORDS`` distinct words are in no pair, and a
    record is in none with itself; an empty table gives no pairs.
    """
    pairs, classes = similar_sets(df, id_col, text_col, t, tolerance)
    a_all = pairs.join(classes.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a", "left").select("b", F.coalesce("ia", "a").alias("a"))
    between = a_all.join(classes.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b", "left").select("a", F.coalesce("ib", "b").alias("b"))
    same = classes.select("rep", F.col("id").alias("a")).join(classes.select("rep", F.col("id").alias("b")), "rep").where("a < b").select("a", "b")
    return between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(same)


def duplicate_groups(df: DataFrame, id_col: str, text_col: str, t: Fraction = Fraction(3, 4), left_out: Callable[[DataFrame], DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``(id_col, group_id, group_links)``: each record that has a version of itself, its group, and how many different texts it is linked with.

    ``group_id`` is the smallest id of the group; records without a version have no row.  ``left_out``
    gets the ids of the records that have a version, ``(id)``, and returns those that take no part.
    """
    from quaestor.llm.components import components

    pairs, classes = similar_sets(df, id_col, text_col, t, tolerance)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    members = cut(classes.union(ends.join(classes.select("id"), "id", "left_anti").select("id", F.col("id").alias("rep"))))
    if left_out:
        members = cut(members.join(cut(left_out(members.select("id"))), "id", "left_anti"))
    centres = members.groupBy("rep").agg(F.min("id").alias("centre"))
    a, b = centres.select(F.col("rep").alias("a"), F.col("centre").alias("x")), centres.select(F.col("rep").alias("b"), F.col("centre").alias("y"))
    between = cut(pairs.join(a, "a").join(b, "b").select("x", "y"))
    stars = cut(members.join(centres, "rep").select("id", "centre"))
    groups = components(between.union(stars.where("id <> centre")).toDF("a", "b"))
    links = between.select(F.col("x").alias("centre")).union(between.select("y")).groupBy("centre").agg(F.count(F.lit(1)).alias("links"))
    named = groups.join(stars, "id").join(links, "centre", "left")
    return named.select(F.col("id").alias(id_col), F.col("component").alias("group_id"), F.coalesce("links", F.lit(0)).alias("group_links"))
