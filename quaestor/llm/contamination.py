"""Evaluation texts leaking into training text: pigeonhole edit matching over words.

A document holds a test item if ``WINDOW`` consecutive words of the item occur in it with at most
``budget`` word edits.  Each window is split into ``budget + 1`` pieces; with that many edits at least
one piece is unharmed, so an Aho-Corasick automaton over all pieces finds every candidate place in one
pass over a document.  Around each hit, Myers' bit-parallel distance verifies the windows.

The test items are the stated query set.  They are read in blocks of at most ``BLOCK_WORDS`` words, which
bounds what is sent to the executors, and every block is held against all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12
BUDGET = 1
BLOCK_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?(?:b|i|u|s|em|strong|mark|span|a|sup|sub|code|small)\b[^<>]*>|<!--.*?-->", re.I | re.S)
_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|td|tr|th|table|h[1-6]|blockquote|pre|hr)\b[^<>]*>", re.I)
_TARGET = re.compile(r"\]\([^()\s]*\)")
#: Letters with a stroke that no decomposition takes apart (fixed values), and what replaces them.
_STROKES = tuple(zip("łđħŧøƀɨ", "ldhtobi"))
#: Combining marks and invisible characters, which neither count nor end a word.
_UNSEEN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x80, 0x3000) if unicodedata.category(chr(c)) in ("Mn", "Cf")) + r"\ufe00-\ufe0f\ufeff\U000e0000-\U000e01ef]")


def fold_words(text: str) -> list[str]:
    """The words of a text without case, accents, markup, punctuation, line breaks and invisible characters."""
    if "<" in text:
        text = _BLOCK_TAG.sub(" ", _TAG.sub("", text))
    if "](" in text:
        text = _TARGET.sub("]", text)
    if "&" in text:
        import html

        text = html.unescape(text)
    text = text.casefold()
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
        for letter, plain in _STROKES:
            text = text.replace(letter, plain)
    return _WORD.findall(text)


def myers(pattern: list, text: list) -> int:
    """The smallest edit distance of the pattern to any part of the text, over arbitrary symbols."""
    m = len(pattern)
    where: dict = {}
    for k, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for x in text:
        eq = where.get(x, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # the text may begin anywhere
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        best = min(best, score)
    return best


class Matcher:
    """The pieces of a block of items, ready to be searched for."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], window: int, budget: int) -> None:
        import ahocorasick

        self.window, self.budget, self.items = window, budget, {}
        self.size = size = window // (budget + 1)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, words in items:
            if len(words) < window:
                continue
            self.items[item] = words
            for at in range(len(words) - size + 1):
                pieces.setdefault(" " + " ".join(words[at : at + size]) + " ", []).append((item, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[tuple[int, int, int]]:
        """``(item, distance, longest run of equal words)`` for each item that the text holds."""
        if not self.items:
            return []
        words = fold_words(text)
        line = " " + " ".join(words) + " "
        found: dict[int, list[int]] = {}
        done: dict[tuple[int, int], int] = {}  # where the last long run on a diagonal ends
        last = spaces = 0
        for end, places in self.automaton.iter(line):
            spaces += line.count(" ", last, end + 1)
            last = end + 1
            here = spaces - self.size - 1  # the piece ends with the space behind its last word
            for item, at in places:
                if here + self.size <= done.get((item, here - at), 0):
                    continue
                best = self._verify(words, here, self.items[item], at)
                if best is None:
                    continue
                if best[1] >= self.window:
                    done[item, here - at] = best[2]
                old = found.setdefault(item, [best[0], best[1]])
                old[0], old[1] = min(old[0], best[0]), max(old[1], best[1])
        return [(item, d, run) for item, (d, run) in found.items()]

    def _verify(self, words: list[str], here: int, item: list[str], at: int) -> tuple[int, int, int] | None:
        """Distance, equal run and its end around a piece hit, or None if no window with the piece is within the budget."""
        w, e, size = self.window, self.budget, self.size
        low, high = max(0, at + size - w), min(len(item), at + w)
        around = words[max(0, here - (at - low) - e) : here + (high - at) + e]
        near = set(around)
        known = [x in near for x in item[low:high]]
        if sum(known) < w - e:
            return None
        windows = range(low, min(at, len(item) - w) + 1)  # those whose words occur often enough nearby
        distance = min((myers(item[s : s + w], around) for s in windows if sum(known[s - low : s - low + w]) >= w - e), default=w)
        if distance > e:
            return None
        left, right = 0, size
        while left < min(at, here) and item[at - left - 1] == words[here - left - 1]:
            left += 1
        while at + right < len(item) and here + right < len(words) and item[at + right] == words[here + right]:
            right += 1
        return distance, left + right, here + right


def _blocks(items: Iterable[tuple[int, list[str]]], most: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, n = [], 0
    for item, words in items:
        if block and n + len(words) > most:
            yield block
            block, n = [], 0
        block.append((item, words))
        n += len(words)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", parts: tuple[str, ...] = ("question", "answer"), window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """``(id_col BIGINT, item_col BIGINT, distance INT, run INT)``: each document with each item it holds.

    ``distance`` is the smallest number of word edits, ``run`` the longest run of equal consecutive words.
    Parts of an item are read one after the other, null ones as empty.  Items of fewer than ``window``
    words cannot leak; null and empty texts hold nothing; no items or no documents give no rows.
    Documents with the same id are searched one by one.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    queries = items.select(F.col(item_col).cast("long"), F.concat_ws(" ", *parts))
    schema = f"{id_col} long, {item_col} long, distance int, run int"
    out = spark.createDataFrame([], schema)
    for block in _blocks(((r[0], fold_words(r[1])) for r in queries.toLocalIterator()), BLOCK_WORDS):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, window, budget)
            for batch in batches:
                rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.leaks(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], [id_col, item_col, "distance", "run"])

        out = out.union(texts.mapInArrow(run, schema))
    return out
