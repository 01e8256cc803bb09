"""Filling containers of fixed capacity: shortest-pack-first packing over the histogram of lengths.

Only the histogram (at most ``capacity`` rows, whatever the size of the data) comes to the driver.  There
the lengths are placed longest first; equal packs are one *pattern* with a count, so the work depends on
the capacity and not on the number of items.  Each slot of a pattern then takes a range of ranks within
its length, and items find their container by rank.  Ranks are made per (length, salt) with offsets, with
one salt for every ``SALT_ROWS`` items of a length, so a length that a third of all items share is spread
over many tasks, and the driver sees one row for each.

What is broadcast is bounded by the capacity alone: placing a length opens at most two patterns and splits
at most one, so there are at most ``3 * capacity`` patterns, with at most ``sqrt(2 * capacity)`` different
lengths each: 9 MB for a capacity of 2048.
"""

from __future__ import annotations

from bisect import insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import SPACES
from quaestor.plans.cut import cut

#: Tokens of the public word-and-punctuation tokenizer, ``\w+|[^\w\s]+`` with Unicode classes.
TOKEN_PATTERN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACES}]+"
#: Items of one length that are ranked together.
SALT_ROWS = 500_000


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def pack_histogram(histogram: dict[int, int], capacity: int, largest_gap_first: bool = True) -> list[tuple[int, list[int]]]:
    """``[(count, lengths)]``: how many containers have which content.

    ``histogram`` has the number of items of each length from 1 to ``capacity``.  Lengths are placed from
    the longest on; each goes into the open pack with the largest gap (the *shortest pack first*), or,
    with ``largest_gap_first=False``, into the one with the smallest gap that still holds it.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    gaps: list[int] = []

    def put(gap: int, count: int, pack: tuple[int, ...]) -> None:
        if gap not in open_packs:
            open_packs[gap] = []
            insort(gaps, gap)
        open_packs[gap].append((count, pack))

    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left = histogram[length]
        fresh: list[tuple[int, int, tuple[int, ...]]] = []
        while left > 0:
            if largest_gap_first:
                gap = gaps[-1] if gaps and gaps[-1] >= length else None
            else:
                gap = next((g for g in gaps if g >= length), None)
            if gap is None:
                n = capacity // length  # open new packs, each filled with as many of this length as it holds
                full, some = divmod(left, n)
                if full:
                    fresh.append((capacity - n * length, full, (length,) * n))
                if some:
                    fresh.append((capacity - some * length, 1, (length,) * some))
                left = 0
                break
            count, pack = open_packs[gap].pop()
            if not open_packs[gap]:
                del open_packs[gap]
                gaps.remove(gap)
            take = min(count, left)
            if take < count:
                put(gap, count - take, pack)
            put(gap - length, take, (*pack, length))
            left -= take
        for gap, count, pack in fresh:
            put(gap, count, pack)
    return [(count, list(pack)) for gap in reversed(gaps) for count, pack in open_packs[gap]]


def best_packing(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first, or its fullest-pack-first variant if that needs fewer containers."""
    both = [pack_histogram(histogram, capacity, x) for x in (True, False)]
    return min(both, key=lambda p: sum(n for n, _ in p))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """``(id_col, piece_no, n_pieces, n_tokens, size, container BIGINT)``: one row per piece of each text.

    A text is one piece unless it has more than ``capacity`` tokens; then it is cut into pieces of
    ``capacity`` tokens and a rest.  Containers are numbered from 0.  Null texts and texts without
    tokens take no space and give no rows.  Equal ids are items of their own.
    """
    spark = df.sparkSession
    counted = df.select(F.col(id_col), token_count(F.col(text_col)).alias("n_tokens")).where("n_tokens > 0")
    sized = counted.withColumn("n_pieces", F.expr(f"cast((n_tokens + {capacity - 1}) div {capacity} as int)"))
    pieces = sized.select(id_col, "n_tokens", "n_pieces", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))).alias("piece_no"))
    pieces = pieces.withColumn("size", F.when(F.col("piece_no") < F.col("n_pieces"), capacity).otherwise(F.col("n_tokens") - (F.col("n_pieces") - 1) * capacity))
    pieces = cut(pieces)
    per_length = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    salts = [(size, -(-n // SALT_ROWS)) for size, n in per_length.items()]
    salted = pieces.join(F.broadcast(spark.createDataFrame(salts, "size int, salts int")), "size")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece_no"), F.col("salts")).cast("int")).drop("salts")

    counts = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + items / SALT_ROWS rows
    histogram: dict[int, int] = {}
    offsets = []
    for size, salt, n in sorted((r["size"], r["salt"], r["n"]) for r in counts):
        offsets.append((size, salt, histogram.get(size, 0)))
        histogram[size] = histogram.get(size, 0) + n

    slots, used, base = [], dict.fromkeys(histogram, 0), 0
    for count, lengths in best_packing(histogram, capacity):
        for length in sorted(set(lengths)):
            slots.append((length, used[length], count, base))
            used[length] += count * lengths.count(length)
        base += count
    ranked = salted.join(F.broadcast(spark.createDataFrame(offsets, "size int, salt int, skip long")), ["size", "salt"])
    order = Window.partitionBy("size", "salt").orderBy(F.col(id_col).asc_nulls_first(), "piece_no")
    ranked = ranked.withColumn("rank", F.col("skip") + F.row_number().over(order) - 1)
    found = ranked.join(F.broadcast(_slot_table(spark, slots)), "size").withColumn("k", F.expr("size(filter(starts, x -> x <= rank)) - 1"))
    return found.select(id_col, "piece_no", "n_pieces", "n_tokens", "size", F.expr("bases[k] + (rank - starts[k]) % counts[k]").alias("container"))


def _slot_table(spark, slots: list[tuple[int, int, int, int]]) -> DataFrame:
    """One row per length: where the rank ranges of its patterns start, and the number and first container of each pattern."""
    by: dict[int, tuple[list[int], list[int], list[int]]] = {}
    for length, start, count, base in sorted(slots):
        for values, x in zip(by.setdefault(length, ([], [], [])), (start, count, base)):
            values.append(x)
    return spark.createDataFrame([(k, *v) for k, v in by.items()], "size int, starts array<long>, counts array<long>, bases array<long>")
