"""Splitting oversized texts at natural boundaries, with overlap, in JVM expressions only.

One regular expression with bounded quantifiers consumes a piece: its alternatives, ordered by the
strength of the boundary (the rest of the text, paragraph, line, sentence, word, any character), take
as much as fits.  The overlap comes from offsets: each piece begins ``overlap`` characters before the
place where the one before it ended.  Lengths are code points throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import SPACES

#: A paragraph, line or sentence boundary counts only beyond this share of the limit.
MIN_FILL = 0.5


def piece_pattern(limit: int) -> str:
    """A pattern that matches between 1 and ``limit`` characters, up to the strongest boundary in reach."""
    low = max(1, int(limit * MIN_FILL))
    return (
        "(?s)(?:"
        rf".{{1,{limit}}}\z"
        rf"|.{{{low},{limit - 4}}}(?:\r?\n){{2}}"
        rf"|.{{{low},{limit - 1}}}\n"
        rf"|.{{{low},{limit - 3}}}[.!?…][\"”»)\]]?[{SPACES}]"
        rf"|.{{1,{limit - 1}}}[{SPACES}]"
        rf"|.{{1,{limit}}})"
    )


def pieces_expr(text: Column, limit: int, overlap: int) -> Column:
    """``ARRAY<STRUCT<start, core_start, end>>``: 0-based offsets of each piece; ``core_start`` is where the new part begins."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    first = F.regexp_extract(text, r"\A" + piece_pattern(limit), 0)
    rest = F.regexp_extract_all(F.substr(text, F.length(first) + 1), F.lit(piece_pattern(limit - overlap)), F.lit(0))
    sizes = F.transform(F.concat(F.array(first), rest), F.length)
    empty = F.expr("cast(array() as array<struct<start:int,core_start:int,end:int>>)")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("last"), empty.alias("out"))

    def step(acc: Column, n: Column) -> Column:
        begin = F.greatest(acc["at"] - overlap, acc["last"])
        piece = F.struct(begin.alias("start"), acc["at"].alias("core_start"), (acc["at"] + n).alias("end"))
        return F.struct((acc["at"] + n).alias("at"), begin.alias("last"), F.concat(acc["out"], F.array(piece)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def split_texts(df: DataFrame, id_col: str = "page_id", text_col: str = "text", limit: int = 15000, overlap: int = 200) -> DataFrame:
    """``(id_col, piece_no INT, start INT, piece STRING, mid_word BOOLEAN)`` for each text longer than ``limit``.

    Pieces are numbered from 1, hold at most ``limit`` characters, and each one after the first begins
    with the last ``overlap`` characters of the one before (the whole of it, if it is shorter).
    ``mid_word`` tells that the piece ends inside a word because no white space was in reach.  Null,
    empty and shorter texts give no rows.  Dropping the overlaps restores the text exactly.
    """
    long = df.select(F.col(id_col), F.col(text_col).alias("_text")).where(F.length("_text") > limit)
    cut = long.select(id_col, "_text", F.posexplode(pieces_expr(F.col("_text"), limit, overlap)).alias("_no", "_p"))
    piece = F.substr(F.col("_text"), F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start"))
    inside = ~F.substr(F.col("_text"), F.col("_p.end"), F.lit(2)).rlike(f"[{SPACES}]")
    return cut.select(
        id_col,
        (F.col("_no") + 1).alias("piece_no"),
        F.col("_p.start").alias("start"),
        piece.alias("piece"),
        (inside & (F.col("_p.end") < F.length("_text"))).alias("mid_word"),
    )


def cut_kinds(df: DataFrame, id_col: str = "page_id", text_col: str = "text", limit: int = 15000, overlap: int = 200) -> DataFrame:
    """``(id_col, cut_kind)``, one row per oversized text: ``forced`` if a run of more than ``limit`` characters has no white space.

    A text is looked at for such a run only if the splitter had to cut it inside a word.  One pass, row by
    row; rows with the same id are judged one by one.
    """
    long = df.select(F.col(id_col), F.col(text_col).alias("_text")).where(F.length("_text") > limit)
    text = F.col("_text")
    inside = lambda p: (p["end"] < F.length(text)) & ~F.substr(text, p["end"], F.lit(2)).rlike(f"[{SPACES}]")
    mid = F.exists(pieces_expr(text, limit, overlap), inside)
    forced = F.when(mid, text.rlike(rf"[^{SPACES}]{{{limit + 1}}}")).otherwise(F.lit(False))
    return long.select(id_col, F.when(forced, "forced").otherwise("natural").alias("cut_kind"))
