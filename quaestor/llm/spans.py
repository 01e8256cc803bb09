"""Long exact spans shared between records: a compacted de Bruijn graph over sampled k-mers.

1. Every text is hashed at all character k-mers, the edges of its de Bruijn graph; of each ``WINDOW``
   consecutive ones the smallest is kept (a minimizer).  The choice depends on the characters inside a
   window only, so texts with a span of at least ``WINDOW + K - 1`` = 300 characters in common have at
   least one sampled edge in common, inside that span: none is missed.
2. Edges found in one text only are dropped; what is left is the repeated part of the graph.
3. Nonbranching paths are compacted to their heads, the edges that texts reach from different edges, at
   different distances or from text of their own.  Where two texts begin to agree, some head lies within
   the first 300 characters that they share: go back from any edge of these while both texts come from the
   same one; the last such edge is reached from different ones.
4. Source coordinates prove the spans: the windows of 300 characters around each head are compared by hash
   and first character.  Texts that hold the same window behind *different* characters begin to agree
   there, so each common span of two texts shows once, at its start, however long it is and however many
   texts hold it.  No pair is made before that, and no text is joined with another.

Equal texts are represented by the one with the smallest id until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.plans.cut import cut, sized

MIN_SPAN = 300
K = 150
WINDOW = 151
#: Rows after which a Python worker hands on what it made.
FLUSH_ROWS = 500_000
_POS_MASK = np.uint64((1 << 28) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)

assert WINDOW + K - 1 <= MIN_SPAN

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of the base and of its inverse modulo 2**64, up to the n-th."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        ones = np.full(size, _BASE, np.uint64)
        ones[0] = 1
        _powers = np.multiply.accumulate(ones)
        ones = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        ones[0] = 1
        _inverses = np.multiply.accumulate(ones)


def anchors(text: str, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """``(positions, hashes)`` of a text's anchors in order; none for texts shorter than a window.

    Windows are taken ``step`` at a time, which bounds the memory a very long text needs.
    """
    windows = len(text) - K + 1 - WINDOW + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = [_anchors(text[s : s + min(step, windows - s) + WINDOW + K - 2]) for s in range(0, windows, step)]
    at, first = np.unique(np.concatenate([a + k * step for k, (a, _) in enumerate(found)]), return_index=True)
    return at, np.concatenate([h for _, h in found])[first]


def _anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - K + 1
    _grow(len(codes) + 1)
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((codes + np.uint64(1)) * _powers[: len(codes)], out=sums[1:])
    h = (sums[K:] - sums[:-K]) * _inverses[:n]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    key = (h & ~_POS_MASK) | np.arange(n, dtype=np.uint64)
    pad = -n % WINDOW
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - WINDOW + 1], ahead[WINDOW - 1 : n])
    at = np.unique(least & _POS_MASK).astype(np.int64)
    return at, h[at]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ords, positions, hashes = [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, h = anchors(text)
            ids.append(np.full(len(at), i, np.int64)), ords.append(np.arange(len(at), dtype=np.int32))
            positions.append(at.astype(np.int32)), hashes.append(h.astype(np.int64))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (hashes, ids, ords, positions)], ["edge", "id", "ord", "pos"])


def graph_edges(texts: DataFrame) -> DataFrame:
    """``(edge, id, ord, pos)``: each text's sampled edges, numbered in order, and where they begin."""
    return texts.select("id", "text").mapInArrow(_edges, "edge long, id long, ord int, pos int")


def path_heads(spots: DataFrame) -> DataFrame:
    """``(edge)``: heads of the nonbranching paths of the repeated edges at ``spots (edge, id, ord, pos)``.

    An edge continues a path if all its occurrences follow the same edge at the same distance.
    """
    order = Window.partitionBy("id").orderBy("ord")
    step = F.xxhash64(F.lag("edge").over(order), F.col("pos") - F.lag("pos").over(order))
    seen = spots.select("edge", F.when(F.lag("ord").over(order) == F.col("ord") - 1, step).alias("before"))
    ways = seen.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.count("before").alias("known"), F.min("before").alias("lo"), F.max("before").alias("hi"))
    return ways.where("known < n or lo <> hi").select("edge")


def text_classes(texts: DataFrame) -> DataFrame:
    """``(id, rep)`` for texts that occur more than once; ``rep`` is the smallest id with the same text."""
    keyed = texts.select("id", F.xxhash64("text").alias("a"), F.hash("text", F.length("text")).alias("b"))
    many = keyed.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "rep")
    return keyed.join(many, ["a", "b"]).select("id", "rep")


def repeated_edges(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(texts, classes, spots)``: the texts that are long enough, the classes of equal ones, and where sampled edges found in more than one text stand."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where((F.length("text") >= MIN_SPAN) & F.col("id").isNotNull())
    classes = cut(text_classes(texts))
    copies = cut(classes.where("id <> rep").select("id"))
    edges = cut(graph_edges(texts).join(sized(copies), "id", "left_anti"))
    often = edges.groupBy("edge").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("edge")
    return texts, classes, cut(edges.join(often, "edge"))


def span_starts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(spans, classes)``: ``(a, b, start_a, start_b)`` where different texts begin to agree for at least ``MIN_SPAN`` characters, and the classes of equal texts.

    Null ids, null texts and texts shorter than ``MIN_SPAN`` take no part.  Starts are 0-based; where a
    text repeats the window after the same character, its first place stands for all.
    """
    texts, classes, spots = repeated_edges(df, id_col, text_col)
    places = spots.join(path_heads(spots), "edge", "left_semi").groupBy("id").agg(F.collect_list("pos").alias("at"))
    windows = windows_around(texts, cut(places)).groupBy("h", "c", "prev", "id").agg(F.min("start").alias("start"))
    windows = cut(windows)
    ways = windows.groupBy("h", "c", "prev").agg(F.count(F.lit(1)).alias("n"))
    met = ways.groupBy("h", "c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ways"), F.max_by("prev", "n").alias("most"), F.min("prev").alias("least"))
    met = met.where(f"n > 1 and (ways > 1 or least = {_NOTHING})").select("h", "c", "most")
    there = cut(windows.join(met, ["h", "c"]))
    # behind the most frequent character nobody begins to agree with anybody: one side is the others
    x = there.where(f"prev <> most or prev = {_NOTHING}").select("h", "c", F.col("prev").alias("p"), F.col("id").alias("x"), F.col("start").alias("at_x"))
    y = there.select("h", "c", F.col("prev").alias("q"), F.col("id").alias("y"), F.col("start").alias("at_y"))
    both = x.join(y, ["h", "c"]).where(f"x <> y and (p <> q or p = {_NOTHING})")
    ahead = F.col("x") < F.col("y")
    picked = [F.when(ahead, F.col(u)).otherwise(F.col(v)).alias(name) for u, v, name in (("x", "y", "a"), ("y", "x", "b"), ("at_x", "at_y", "start_a"), ("at_y", "at_x", "start_b"))]
    return cut(both.select(*picked).distinct()), classes


def sharing_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a BIGINT, b BIGINT)``, a < b: records with a common verbatim span of at least ``MIN_SPAN`` characters, copies included.

    Null ids and texts and texts that are too short are in no pair, and a record is in none with itself;
    an empty table gives no pairs.
    """
    spans, classes = span_starts(df, id_col, text_col)
    reps = spans.select("a", "b").distinct()
    a_all = reps.join(classes.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a", "left").select("b", F.coalesce("ia", "a").alias("a"))
    between = a_all.join(classes.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b", "left").select("a", F.coalesce("ib", "b").alias("b"))
    same = classes.select("rep", F.col("id").alias("a")).join(classes.select("rep", F.col("id").alias("b")), "rep").where("a < b").select("a", "b")
    return between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(same)


#: Stands for the character before the start of a text; no two texts have it in common.
_NOTHING = -1


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all spans of MIN_SPAN characters that hold one of the given edges, where they begin, with their first character and the one before."""

    def flush(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["h", "id", "start", "c", "prev"])

    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, text, positions in zip(*(c.to_pylist() for c in batch.columns)):
            last = len(text) - MIN_SPAN
            marks = np.zeros(last + 2, np.int64)
            at = np.array(positions)
            np.add.at(marks, np.clip(at - (MIN_SPAN - K), 0, last + 1), 1)
            np.add.at(marks, np.clip(at + 1, 0, last + 1), -1)
            starts = np.flatnonzero(np.cumsum(marks)[: last + 1] > 0)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            _grow(len(codes) + 1)
            sums = np.r_[np.uint64(0), np.cumsum((codes + np.uint64(1)) * _powers[: len(codes)])]
            h = (sums[starts + MIN_SPAN] - sums[starts]) * _inverses[starts]
            before = np.r_[np.int32(_NOTHING), codes.astype(np.int32)]
            out[0].append((h ^ (h >> np.uint64(31))).astype(np.int64)), out[1].append(np.full(len(h), i, np.int64))
            out[2].append(starts.astype(np.int32)), out[3].append(codes[starts].astype(np.int32)), out[4].append(before[starts])
            if sum(map(len, out[0])) > FLUSH_ROWS:
                yield flush(out)
                out = [[], [], [], [], []]
        if out[0]:
            yield flush(out)


def windows_around(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``(h, id, start, c, prev)`` of the windows of ``texts (id, text)`` around the edges at ``places (id, at)``."""
    some = cut(texts.join(sized(places.select("id")), "id", "left_semi"))
    return some.join(places, "id").select("id", "text", "at").mapInArrow(_windows, "h long, id long, start int, c int, prev int")


def shared_characters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_chars, shared_chars)``: for each record with a shared span, how many of its characters are shared.

    Overlapping spans count once; copies of a text are shared in full, and each has a row.  No pairs are
    made: spans of ``MIN_SPAN`` characters around repeated edges are compared by a 64-bit hash and their
    first character, so a passage that a third of all texts hold costs one row per text and character.
    """
    texts, classes, spots = repeated_edges(df, id_col, text_col)
    places = cut(spots.groupBy("id").agg(F.collect_list("pos").alias("at")))
    windows = cut(windows_around(texts, places).select("h", "id", "start", "c"))
    often = windows.groupBy("h", "c").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "c")
    per = windows.join(often, ["h", "c"]).groupBy("id").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda acc, s: F.struct((s + MIN_SPAN).alias("end"), (acc["total"] + MIN_SPAN - F.greatest(F.lit(0), acc["end"] - s)).alias("total")),
        lambda acc: acc["total"],
    )
    per = per.select(F.col("id").alias("rep"), covered.alias("shared_chars"))
    lengths = texts.select("id", F.length("text").alias("n_chars"))
    known = lengths.join(classes, "id", "left").withColumn("copied", F.col("rep").isNotNull()).withColumn("rep", F.coalesce("rep", "id"))
    out = known.join(per, "rep", "left").where("copied or shared_chars is not null")
    return out.select(F.col("id").alias(id_col), "n_chars", F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("shared_chars")).alias("shared_chars"))
