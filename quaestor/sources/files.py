"""Directory scans: text files, sidecars, fact files, Word and Excel documents."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.operators.facts import facts_of_files
from quaestor.operators.relational import last_per_key, lookup_source, union_folders


def _names(spark: SparkSession, folder: str, suffix: str) -> list[str] | None:
    """Names of the regular files of a folder that end in ``suffix``, or None if there is no such folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [s.getPath().getName() for s in fs.listStatus(path) if s.isFile()]
    return sorted(n for n in found if n.endswith(suffix))


def scan_text(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """``(file, text)``: the whole text of each file, line ends as LF; a missing folder gives no rows.

    Spark leaves out empty files and names that begin with ``_`` or ``.``; those are listed on the driver
    and read or added one by one.
    """
    empty = spark.createDataFrame([], "file string, text string")
    names = _names(spark, folder, suffix)
    if not names:
        return empty
    found = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    found = found.withColumn("file", F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))))
    hidden = [n for n in names if n[0] in "_."]
    rows = [(n, _read(spark, f"{folder}/{n}")) for n in hidden]
    if hidden:
        found = found.union(spark.createDataFrame(rows, "file string, text string"))
    everything = spark.createDataFrame([(n,) for n in names], "file string").join(found, "file", "left")
    return everything.select("file", text.normal_newlines(F.coalesce("text", F.lit(""))).alias("text"))


def _read(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def scan_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, source_url)`` of each JSON file of a folder; files that are no JSON object stop the job."""
    raw = scan_text(spark, folder, ".json")
    parsed = F.from_json("text", "map<string,string>", {"mode": "FAILFAST", "allowSingleQuotes": "false"})
    return raw.select("file", parsed["source_url"].alias("source_url"))


def scan_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``(file, text)`` of all folders; of files with one base name the later folder's is taken."""
    both = union_folders([scan_text(spark, f) for f in folders]).withColumn("base", text.base_name(F.col("file")))
    return last_per_key(both, ["base"], ["folder_priority", "file"]).select("file", "text")


def with_sources(texts: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Texts with ``source_url`` from their sidecar, found under either of two names, else the file name."""
    first = text.swap_suffix(F.col("file"), ".txt", ".json")
    second = F.concat(text.base_name(F.col("file")), F.lit(".json"))
    return lookup_source(texts, sidecars, first, second, F.col("file"))


def scan_facts(spark: SparkSession, folder: str, keep_prefix: bool = False) -> DataFrame:
    """``(file, pos, source, fact)`` of all fact files of a folder."""
    return facts_of_files(scan_text(spark, folder, ".json"), keep_prefix)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(name: str, content: bytes) -> str:
    """A title line and the body's non-blank paragraphs; tables, headers and footers are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = []
    for p in body.findall(f"{_W}p"):
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
        line = "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)
        if line.strip():
            lines.append(line)
    return f"Source: Word document {name}\n" + "\n".join(lines)


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference).group(0):
        n = 26 * n + ord(ch) - 64
    return max(n - 1, 0)


#: Numbers of the built-in formats that show dates or times (fixed values of the file format).
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
#: What of a format is no code: quoted and escaped text, colours and conditions.
_FORMAT_TEXT = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles of a workbook that show a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): bool(re.search("[ymdhs]", _FORMAT_TEXT.sub("", f.get("formatCode") or ""), re.I)) for f in root.iter(f"{_X}numFmt")}
    cells = root.find(f"{_X}cellXfs")
    formats = [int(x.get("numFmtId") or 0) for x in cells.findall(f"{_X}xf")] if cells is not None else []
    return {k for k, n in enumerate(formats) if own.get(n, n in _DATE_FORMATS)}


def _moment(serial: str, since_1904: bool) -> str:
    """The date and time of a serial number of days, to the second; a pure time of day below 1."""
    try:
        days = float(serial)
    except ValueError:
        return serial
    seconds = round(days * 86400)
    if 0 <= days < 1 and not since_1904:
        return str(datetime.timedelta(seconds=seconds)).rjust(8, "0")
    start = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30 if days >= 60 else 31)  # 1900 was no leap year
    return str(start + datetime.timedelta(seconds=seconds))


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """``(sheet, rows of cells)`` in the workbook's order; cells as text, missing ones empty.

    Dates and times come as ``2020-05-03 00:00:00``, truth values as ``True`` and ``False``, as a data frame shows them.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_X}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        dates = _date_styles(z)
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        since_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_X}workbookPr"))
        for sheet in book.iter(f"{_X}sheet"):
            target = links[sheet.get(f"{_R}id")]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            rows = []
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_X}row"):
                cells: list[str] = []
                for c in row.findall(f"{_X}c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value = c.find(f"{_X}v")
                    if c.get("t") == "s" and value is not None:
                        cells[at] = shared[int(value.text)]
                    elif c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_X}t"))
                    elif value is None or not value.text:
                        cells[at] = ""
                    elif c.get("t") == "b":
                        cells[at] = str(value.text == "1")
                    elif c.get("t", "n") == "n" and int(c.get("s") or 0) in dates:
                        cells[at] = _moment(value.text, since_1904)
                    else:
                        cells[at] = value.text
                rows.append(cells)
            out.append((sheet.get("name"), rows))
    return out


def xlsx_text(name: str, content: bytes) -> str:
    """A title line, then each sheet's name and its rows as a markdown table whose first row is the head."""
    text_ = f"Source: Excel file {name}\n"
    for sheet, rows in xlsx_sheets(content):
        width = max(map(len, rows), default=0)
        table = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        if table:
            table.insert(1, "|" + "---|" * width)
        text_ += f"\nSheet: {sheet}\n" + "\n".join(table)
    return text_


def scan_office(spark: SparkSession, folder: str, enabled: bool = True) -> DataFrame:
    """``(file, text, source_url, error)`` of each ``.docx`` and ``.xlsx`` file; suffixes are case-sensitive, other files ignored.

    Unreadable files have an error and no text.  Disabled, or without the folder, there are no rows.
    """
    schema = "file string, text string, source_url string, error string"
    if not enabled or not _names(spark, folder, ""):
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    read = docx_text if name.endswith(".docx") else xlsx_text
                    rows.append((name + ".txt", read(name, bytes(content)), name, None))
                except Exception as e:  # a broken file is reported, not fatal
                    rows.append((name + ".txt", None, name, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["file", "text", "source_url", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx}").load(folder)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.select(name.alias("name"), "content").mapInPandas(run, schema)
