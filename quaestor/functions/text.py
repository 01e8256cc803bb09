"""Scalar text functions as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at both ends, as Unicode defines it, with the four separator controls.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def after_first(text: Column, marker: str) -> Column:
    """What follows the first occurrence of the marker; the text itself if there is none; null for null."""
    at = F.instr(text, F.lit(marker))
    return F.when(at > 0, F.substr(text, at + F.lit(len(marker)))).otherwise(text)


def before_first(text: Column, marker: str) -> Column:
    """What precedes the first occurrence of the marker; the text itself if there is none; null for null."""
    at = F.instr(text, F.lit(marker))
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)


def between_markers(text: Column, head: str, foot: str) -> Column:
    """First what follows the head marker, then what of it precedes the foot marker."""
    return before_first(after_first(text, head), foot)


def safe_name(url: Column) -> Column:
    """A file name for an address: without ``https://``, slashes as underscores, none of these at the ends."""
    return F.btrim(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("/"), F.lit("_")), F.lit("_"))


def page_header(url: Column, text: Column) -> Column:
    return F.concat(F.lit("URL: "), url, F.lit("\n\n"), text)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, _ENDS, "")


def is_blank(text: Column) -> Column:
    """True for texts of nothing but white space, false for null."""
    return F.coalesce(strip(text) == "", F.lit(False))


def normal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def base_name(file: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file, r"(?<=[^.])\.[^.]*$", "")


def facts_name(file: Column) -> Column:
    return F.concat(base_name(file), F.lit("_facts.json"))


def swap_suffix(file: Column, old: str, new: str) -> Column:
    """Every occurrence of one suffix replaced by another."""
    return F.replace(file, F.lit(old), F.lit(new))


def chunks(text: Column, size: int) -> Column:
    """``ARRAY<STRUCT<chunk_no, chunk>>``: consecutive parts of ``size`` characters; empty for empty and null texts."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), ((F.length(text) - 1) / size).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.struct(i.alias("chunk_no"), F.substr(text, i * size + 1, F.lit(size)).alias("chunk")))


def without_code_fence(text: Column) -> Column:
    """Code fences removed, but only from texts that begin with one."""
    fence = "`" * 3
    cleared = F.replace(F.replace(text, F.lit(fence + "json"), F.lit("")), F.lit(fence), F.lit(""))
    return F.when(F.startswith(text, F.lit(fence)), cleared).otherwise(text)


def or_default(value: Column, present: Column, default: str) -> Column:
    """The value where the key is present, even a null one; the default where it is absent."""
    return F.when(present, value).otherwise(F.lit(default))


def markdown_row(cells: Column) -> Column:
    """One table row; null cells are empty."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c.cast("string"), F.lit(""))), " | "), F.lit(" |"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
