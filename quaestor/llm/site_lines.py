"""Lines repeated across one site's documents, found with suffix arrays over line identifiers.

1. Every line with a letter gets an identifier, a hash of its site and its letters.  Identifiers seen in
   one document only cannot be part of anything repeated; they are where the sequences are broken into
   *runs*.  Equal runs are added up before anything else, so the size of a site, or the number of pages
   that end in the same block, does not matter to any task.
2. A block that is always preceded by the same line is part of a longer one, so blocks begin only at *heads*,
   identifiers that follow different lines or none.
3. The suffixes that begin at heads are compared over their next ``STEP`` lines: range-partitioned and sorted
   they are one suffix array of all sites, cut into partitions that may fall inside a site.  One scan per
   partition compares neighbours; neighbours with a common prefix of k lines are a block of k lines, with
   the documents that hold it.  Blocks that continue over a border are added up.
4. Suffixes whose whole part is repeated go on with the next lines, twice as many each time, until none is
   left: no block is too long, and a suffix costs in proportion to the blocks it begins.
5. What the longest blocks with at least ``min_docs`` documents cover is deleted.

Within a document a block counts once: each place knows how many of its lines stood there before in the same
document (the longest previous factors, from the document's own suffix array), and counts only beyond these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import site_of
from quaestor.plans.cut import cut

#: Lines that suffixes are compared over in the first round.
STEP = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_identifiers(df: DataFrame, id_col: str, text_col: str, url_col: str) -> DataFrame:
    """``(id, mark, line_no ARRAY<INT>, h ARRAY<BIGINT>)``: the lines with a letter of each document and their identifiers; ``mark`` tells documents with the same id apart."""
    page = df.select(F.col(id_col).alias("id"), F.xxhash64(url_col, text_col).alias("mark"), site_of(F.col(url_col)).alias("site"), F.col(text_col).alias("text"))
    page = page.where("id is not null and site is not null and text is not null")
    keys = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_replace(F.lower(x), r"[^\p{L}]+", "").alias("key")))
    lines = page.select("id", "mark", "site", F.filter(keys, lambda x: x["key"] != "").alias("lines"))
    return lines.select("id", "mark", F.transform("lines", lambda x: x["line_no"]).alias("line_no"), F.transform("lines", lambda x: F.xxhash64(F.col("site"), x["key"])).alias("h"))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a sequence, by prefix doubling."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:]
        order = np.lexsort((after, rank))
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        rank, k = fresh, 2 * k
        if k >= n or rank.max() == n - 1:
            return np.argsort(rank, kind="stable")


def previous_factors(symbols: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest prefix of its suffix that also begins at an earlier place."""
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n < 2 or len(np.unique(symbols)) == n:
        return out
    order = suffix_array(symbols).tolist()
    s = symbols.tolist()
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    common, size = [0] * (n + 1), 0
    for i in range(n):  # common prefixes of neighbours, in linear time
        if rank[i]:
            j = order[rank[i] - 1]
            while i + size < n and j + size < n and s[i + size] == s[j + size]:
                size += 1
            common[rank[i]] = size
            size = max(0, size - 1)
        else:
            size = 0
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    for i in range(n - 1, -1, -1):  # with the later places taken out, the neighbours of a suffix are earlier places
        r = rank[i]
        up, down = before[r], after[r]
        out[i] = max(common[r] if up >= 0 else 0, common[down] if down < n else 0)
        if down < n:
            common[down] = min(common[r], common[down])
            before[down] = up
        if up >= 0:
            after[up] = down
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, mark, copies, line_no, run, seen)``: each document's runs of consecutive lines with known identifiers."""
    for batch in batches:
        out = []
        for i, x in zip(*(c.to_pylist() for c in batch.columns)):
            lines, copies = [], []
            for y in x:  # rows that are equal in everything give every line as often
                at = (y["mark"], y["ord"])
                if lines and lines[-1][0] == at:
                    copies[-1] += 1
                else:
                    lines.append((at, y["line_no"], y["h"])), copies.append(1)
            ids = np.array([h for _, _, h in lines], np.int64)
            breaks = [k for k in range(1, len(lines)) if lines[k][0] != (lines[k - 1][0][0], lines[k - 1][0][1] + 1)]
            apart = np.insert(np.unique(ids, return_inverse=True)[1], breaks, len(ids) + np.arange(len(breaks)))  # a symbol of its own between runs
            seen = np.delete(previous_factors(apart), np.array(breaks, np.int64) + np.arange(len(breaks)))
            for a, b in zip([0, *breaks], [*breaks, len(ids)]):
                out.append((i, lines[a][0][0], copies[a], [n for _, n, _ in lines[a:b]], ids[a:b].tolist(), seen[a:b].tolist()))
        kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["id", "mark", "copies", "line_no", "run", "seen"])


def runs_of(lines: DataFrame) -> DataFrame:
    """``(id, mark, copies, line_no, run, seen, kind)``: the runs of all documents; equal ``run`` and ``seen`` are one ``kind``."""
    twice = lines.select("id", F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    flat = lines.select("id", "mark", F.posexplode(F.arrays_zip("line_no", "h")).alias("ord", "x")).select("id", "mark", "ord", "x.line_no", "x.h")
    kept = flat.join(twice.where("lo < hi").select("h"), "h").select("id", F.struct("mark", "ord", "line_no", "h").alias("x"))
    rows = kept.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    kind = lines.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_runs, f"id {kind}, mark long, copies int, line_no array<int>, run array<long>, seen array<int>")
    return found.withColumn("kind", F.xxhash64("run", "seen"))


def _chain(start: int, ids: np.ndarray) -> np.ndarray:
    """A hash for each prefix of ``ids``, going on from the hash of what stands before them."""
    out = np.empty(len(ids), np.uint64)
    h = start & 0xFFFFFFFFFFFFFFFF
    for k, x in enumerate(ids.tolist()):
        h = ((h ^ (x & 0xFFFFFFFFFFFFFFFF)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
        out[k] = h
    return out.astype(np.int64)


def _suffixes(skip: int, step: int):
    """``(kind, pos, base, part, blocks, seen, n)``: of each given place, the next ``step`` lines behind the first ``skip``, with the hashes of all prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, ids, seen, n, places in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.array(ids, np.int64)
                for p in places:
                    whole = _chain(0, ids[p : p + skip + step])
                    if len(whole) > skip:
                        out.append((kind, p, int(whole[skip - 1]) if skip else 0, ids[p + skip : p + skip + step].tolist(), whole[skip:].tolist(), min(max(0, seen[p] - skip), step), n))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["kind", "pos", "base", "part", "blocks", "seen", "n"])

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in a sorted part of the suffix array: for each k, the neighbours with the first k identifiers in common."""
    for batch in batches:
        if not batch.num_rows:
            continue
        base, parts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        seen, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        size = np.array(list(map(len, parts)))
        width = int(size.max())
        rows = np.zeros((len(parts), width + 1), np.int64)
        rows[:, 0] = base
        for k, x in enumerate(parts):
            rows[k, 1 : len(x) + 1] = x
        inside = np.arange(width)[None, :] < size[:, None]
        same = np.cumprod(rows[1:] == rows[:-1], axis=1).astype(bool)
        block = rows[:, 0].astype(np.uint64)
        for k in range(1, width + 1):
            block = (block ^ rows[:, k].astype(np.uint64)) * _MIX
            block ^= block >> np.uint64(29)
            start = np.flatnonzero(np.r_[True, ~(same[:, k] & inside[1:, k - 1] & inside[:-1, k - 1])])
            docs = np.add.reduceat(np.where((seen < k) & inside[:, k - 1], n, 0), start)
            at = start[(docs > 0) & inside[start, k - 1]]
            live = docs[(docs > 0) & inside[start, k - 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(block[at].astype(np.int64)), pa.array(live)], ["k", "block", "docs"])


def _longer(kinds: DataFrame, places: DataFrame, skip: int, step: int, min_docs: int) -> DataFrame:
    """``(kind, pos, k, block, docs)``: for each of ``places (kind, at)`` the longest block it begins, if it has more than ``skip`` lines and at most ``skip + step``."""
    parts = cut(kinds.join(places, "kind").select("kind", "run", "seen", "n", "at").mapInArrow(_suffixes(skip, step), "kind long, pos int, base long, part array<long>, blocks array<long>, seen int, n long"))
    whole = parts.groupBy("base", "part", "seen").agg(F.sum("n").alias("n"))
    array = whole.select("base", "part", "seen", "n").repartitionByRange("base", "part").sortWithinPartitions("base", "part")
    found = array.mapInArrow(_scan, "k int, block long, docs long").groupBy("k", "block").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    prefixes = parts.select("kind", "pos", F.posexplode("blocks").alias("k", "block")).withColumn("k", F.col("k") + 1)
    best = prefixes.join(found, ["k", "block"]).groupBy("kind", "pos").agg(F.max(F.struct("k", "block", "docs")).alias("b"))
    return cut(best.select("kind", "pos", (F.col("b.k") + skip).alias("k"), "b.block", "b.docs"))


def repeated_blocks(kinds: DataFrame, min_docs: int = 5) -> DataFrame:
    """``(kind, pos, k, block, docs)`` of ``kinds (kind, run, seen, n)``: at each head the longest block of k lines found in at least ``min_docs`` documents of a site."""
    steps = kinds.select(F.posexplode("run").alias("pos", "h"), "run").select("h", F.when(F.col("pos") > 0, F.get("run", F.col("pos") - 1)).alias("before"))
    ways = steps.groupBy("h", "before").count().groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count("before").alias("known"))
    heads = ways.where("n > 1 or known = 0").select("h")
    begin = kinds.select("kind", F.posexplode("run").alias("pos", "h")).join(heads, "h")
    places = cut(begin.groupBy("kind").agg(F.collect_list("pos").alias("at")))
    skip, step, levels = 0, STEP, []
    while True:
        found = _longer(kinds, places, skip, step, min_docs)
        levels.append(found)
        skip, step = skip + step, 2 * step
        further = found.where(F.col("k") == skip)
        if not further.limit(1).count():
            break
        places = cut(further.groupBy("kind").agg(F.collect_list("pos").alias("at")))
    every = levels[0]
    for found in levels[1:]:
        every = every.union(found)
    return cut(every.groupBy("kind", "pos").agg(F.max(F.struct("k", "block", "docs")).alias("b")).select("kind", "pos", "b.*"))


def _blocks_of(df: DataFrame, id_col: str, text_col: str, url_col: str, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The runs of all documents and the blocks that their kinds hold."""
    runs = cut(runs_of(cut(line_identifiers(df, id_col, text_col, url_col))))
    kinds = cut(runs.groupBy("kind").agg(F.any_value("run").alias("run"), F.any_value("seen").alias("seen"), F.count(F.lit(1)).alias("n")))
    return runs, repeated_blocks(kinds, min_docs)


def _covered(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(id, mark, copies, gone ARRAY<INT>)``: of each run, the numbers of the lines that blocks cover."""
    spans = blocks.select("kind", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("k") - 1)).alias("at"))
    cover = cut(spans.groupBy("kind").agg(F.sort_array(F.collect_set("at")).alias("at")))
    return runs.join(cover, "kind").select("id", "mark", "copies", F.transform("at", lambda p: F.get("line_no", p)).alias("gone"))


def repeated_lines(df: DataFrame, id_col: str = "page_id", text_col: str = "text", url_col: str = "url", min_docs: int = 5) -> DataFrame:
    """``(id_col, line_no BIGINT)``: the lines covered by blocks found in at least ``min_docs`` documents of a site.

    Lines are equal if their letters, lower-cased and in order, are equal; lines without letters are
    never repeated, and neighbours are the lines with letters.  Documents with null id, address or text
    have no rows.  An empty table gives no rows.  Repetitions inside one document count once.  Rows with the
    same id count as one document, and each of them has its lines in the result.
    """
    runs, blocks = _blocks_of(df, id_col, text_col, url_col, min_docs)
    each = _covered(runs, blocks).select("id", "gone", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(F.col("id").alias(id_col), F.explode("gone").alias("line_no")).withColumn("line_no", F.col("line_no").cast("bigint"))


def block_report(df: DataFrame, id_col: str = "page_id", text_col: str = "text", url_col: str = "url", min_docs: int = 5) -> DataFrame:
    """``(block BIGINT, n_lines INT, docs BIGINT, first_id, first_line INT)``: each block that is no part of a longer one at the same place, how many lines and documents it has, and one place where it stands."""
    runs, blocks = _blocks_of(df, id_col, text_col, url_col, min_docs)
    per = blocks.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "block", "docs"))).alias("b"))
    end = lambda x: x["pos"] + x["k"]
    whole = F.filter("b", lambda x: ~F.exists("b", lambda y: (y["pos"] < x["pos"]) & (end(y) >= end(x))))
    kept = cut(per.select("kind", F.explode(whole).alias("b")).select("kind", "b.*"))
    where = runs.groupBy("kind").agg(F.min(F.struct("id", "line_no")).alias("w"))
    placed = kept.join(where, "kind").select("block", "k", "docs", F.struct(F.col("w.id"), F.get("w.line_no", F.col("pos")).alias("line")).alias("w"))
    one = placed.groupBy("block", "k").agg(F.max("docs").alias("docs"), F.min("w").alias("w"))
    return one.select("block", F.col("k").alias("n_lines"), "docs", F.col("w.id").alias(f"first_{id_col}"), F.col("w.line").alias("first_line"))


def without_repeated_lines(df: DataFrame, id_col: str = "page_id", text_col: str = "text", url_col: str = "url", min_docs: int = 5) -> DataFrame:
    """``(id_col, removed INT, text_col)``: every document, null texts included, without the blocks that its site repeats.

    Each row loses its own lines only, also where ids repeat.
    """
    runs, blocks = _blocks_of(df, id_col, text_col, url_col, min_docs)
    per = _covered(runs, blocks).groupBy("id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("_gone"))
    kept = F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains("_gone", i + 1))
    named = df.select(F.col(id_col), F.col(text_col), F.xxhash64(url_col, text_col).alias("_mark"))
    joined = named.join(per.select(F.col("id").alias("_id"), F.col("mark").alias("_m"), "_gone"), (F.col(id_col) == F.col("_id")) & (F.col("_mark") == F.col("_m")), "left")
    return joined.select(id_col, F.coalesce(F.size("_gone"), F.lit(0)).alias("removed"), F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", kept)).alias(text_col))
