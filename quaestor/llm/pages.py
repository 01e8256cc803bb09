"""Main content and residue of web pages, as operators over DataFrames.

The per-page analysis is plain Python and runs in Arrow batches inside ``mapInArrow``: no shuffle, one
pass, every page on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), df[text_col].alias("text"))


def body_lines(df: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """``(id_col, line_no INT, role STRING)``: the lines of each page's main content that hold a letter or digit.

    ``role`` is ``heading`` or ``body``.  Null and blank texts and residue pages give no rows; an empty
    table gives an empty result; other columns of ``df`` are ignored.  Rows with a repeated id are
    treated one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quaestor.llm.page_body import analyze
        from quaestor.llm.residue import residue_kind

        for batch in batches:
            ids, nos, roles = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                page = analyze(text)
                if residue_kind(page):
                    continue
                for x in page.heading:
                    ids.append(i), nos.append(x.no), roles.append("heading")
                for x in page.body:
                    ids.append(i), nos.append(x.no), roles.append("body")
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(nos, pa.int32()), pa.array(roles, pa.string())], ["id", "line_no", "role"])

    kind = df.schema[id_col].dataType.simpleString()
    return _pick(df, id_col, text_col).mapInArrow(run, f"id {kind}, line_no int, role string").withColumnRenamed("id", id_col)


def main_text(df: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """``(id_col, main_text STRING)``: each page's heading and body without markup, one row per input row.

    Null, blank and residue pages get an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quaestor.llm.page_body import analyze
        from quaestor.llm.residue import residue_kind

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                page = analyze(text) if text else None
                keep = [] if page is None or residue_kind(page) else page.heading + page.body
                out.append("\n".join(x.text for x in keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "main_text"])

    kind = df.schema[id_col].dataType.simpleString()
    return _pick(df, id_col, text_col).mapInArrow(run, f"id {kind}, main_text string").withColumnRenamed("id", id_col)


def residue_pages(df: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """``(id_col, kind STRING)``: pages without real content and why: ``placeholder``, ``message`` or ``filler``.

    Null and blank texts are no cases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quaestor.llm.residue import residue_of

        for batch in batches:
            ids, kinds = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = residue_of(text) if text else None
                if kind:
                    ids.append(i), kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(kinds, pa.string())], ["id", "kind"])

    kind = df.schema[id_col].dataType.simpleString()
    return _pick(df, id_col, text_col).mapInArrow(run, f"id {kind}, kind string").withColumnRenamed("id", id_col)
