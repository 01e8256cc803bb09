import json
import zipfile

from pyspark.sql import functions as F

from quaestor.config import VERSIONS
from quaestor.plans import pipeline
from quaestor.sources import files, index, pages
from quaestor.streaming.ingest import stream_facts


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def write(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, content in texts.items():
        (folder / name.replace("__dot__", ".")).write_bytes(content.encode())


def test_scan_text(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, content in {"a.txt": "x\r\ny\rz\n", "empty.txt": "", "_h.txt": "h", ".d.txt": "d", "no.csv": "n", "ą b+c%20.txt": "ć"}.items():
        (folder / name).write_bytes(content.encode())
    got = rows(files.scan_text(spark, str(folder)), "file")
    assert sorted(got) == sorted([("a.txt", "x\ny\nz\n"), ("empty.txt", ""), ("_h.txt", "h"), (".d.txt", "d"), ("ą b+c%20.txt", "ć")])
    assert rows(files.scan_text(spark, str(tmp_path / "missing"))) == []


def test_folders_and_sidecars(spark, tmp_path):
    raw, done = tmp_path / "raw", tmp_path / "done"
    for folder, content in ((raw, {"a.txt": "1", "b.txt": "2"}), (done, {"b.txt": "3", "c.docx.txt": "4"})):
        folder.mkdir()
        for name, x in content.items():
            (folder / name).write_text(x)
    (done / "c.docx.json").write_text(json.dumps({"source_url": "c!"}))
    (done / "b.json").write_text(json.dumps({"source_url": None, "more": 1}))
    texts = files.scan_folders(spark, [str(raw), str(done)])
    assert rows(texts, "file") == [("a.txt", "1"), ("b.txt", "3"), ("c.docx.txt", "4")]
    got = rows(files.with_sources(texts, files.scan_sidecars(spark, str(done))).select("file", "source_url"), "file")
    assert got == [("a.txt", "a.txt"), ("b.txt", None), ("c.docx.txt", "c!")]


DOCX = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:r><w:t>Ala </w:t></w:r><w:r><w:t>ma</w:t><w:tab/><w:t>kota</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>"""
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_office_files(spark, tmp_path):
    folder = tmp_path / "office"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.docx", "w") as z:
        z.writestr("word/document.xml", DOCX)
    with zipfile.ZipFile(folder / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>h</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2" t="inlineStr"><is><t>i</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {S}><sheetData/></worksheet>")
    (folder / "c.docx").write_text("broken")
    (folder / "d.DOCX").write_text("other case")
    got = {r["file"]: r for r in files.scan_office(spark, str(folder)).collect()}
    assert set(got) == {"a.docx.txt", "b.xlsx.txt", "c.docx.txt"}
    assert got["a.docx.txt"]["text"] == "Source: Word document a.docx\nAla ma\tkota\nEnd"
    assert got["b.xlsx.txt"]["text"] == "Source: Excel file b.xlsx\n\nSheet: One\n| h |  | 2 |\n|---|---|---|\n| i |  |  |\nSheet: Two\n"
    assert got["c.docx.txt"]["text"] is None and got["c.docx.txt"]["error"]
    assert got["a.docx.txt"]["source_url"] == "a.docx"
    assert rows(files.scan_office(spark, str(folder), enabled=False)) == rows(files.scan_office(spark, str(tmp_path / "none"))) == []


def test_excel_dates_and_truth_values(tmp_path):
    S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} {R}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f"""<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0.00&quot; days&quot;"/></numFmts>
            <cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="20"/></cellXfs></styleSheet>""")
        cells = '<c r="A1" s="1"><v>43954</v></c><c r="B1" s="2"><v>43954.75</v></c><c r="C1" s="3"><v>2.5</v></c><c r="D1" t="b"><v>1</v></c><c r="E1" t="b"><v>0</v></c><c r="F1" s="4"><v>0.5</v></c><c r="G1" s="1"/><c r="H1"><v>7</v></c>'
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {S}><sheetData><row>{cells}</row></sheetData></worksheet>")
    [(_, [row])] = files.xlsx_sheets((tmp_path / "d.xlsx").read_bytes())
    assert row == ["2020-05-03 00:00:00", "2020-05-03 18:00:00", "2.5", "True", "False", "12:00:00", "", "7"]


def test_fetcher(spark):
    class Web:
        def fetch(self, url):
            if url == "down":
                raise OSError("no route")
            return (None if url == "nothing" else f"<{url}>"), ["l"]

    urls = spark.createDataFrame([("a",), ("down",), ("nothing",)], "url string")
    assert rows(pages.fetch_pages(urls, Web), "url") == [("a", "<a>", ["l"], None), ("down", None, [], "no route"), ("nothing", None, [], "no text")]


def test_page_files(spark):
    data = [(1, "https://a.example/x", "head##body©foot"), (2, "https://a.example/x/", "new"), (3, None, "lost"), (4, "b", None)]
    df = spark.createDataFrame(data, "page_id long, url string, text string")
    assert rows(pages.text_files(df, "##", "©", "page_id"), "file") == [("a.example_x.txt", "URL: https://a.example/x/\n\nnew"), ("b.txt", "URL: b\n\n")]
    crawl = spark.createDataFrame([(k, "u", None, "r" if k < 4 else None) for k in range(6)], "page_id long, url string, text string, crawl_root string")
    assert [r[0] for r in rows(pages.crawled_pages(crawl, limit=2), "page_id")] == [0, 1]
    assert rows(pages.crawled_pages(crawl, roots=["other"])) == []


def test_index_and_answers(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = spark.createDataFrame([("a.txt", "cats sleep", "ua"), ("b.txt", "dogs bark", None), ("c.txt", " ", "uc")], "file string, text string, source_url string")
    pipeline.build_index(texts, path, VERSIONS[1])
    assert sorted(r["id"] for r in index.open_index(spark, path).collect()) == ["ids_1", "ids_2"]
    pipeline.build_index(texts, path, VERSIONS[1], only_new=True)
    assert index.open_index(spark, path).count() == 2
    pipeline.build_index(texts, path, VERSIONS[2])
    assert sorted(r["id"] for r in index.open_index(spark, path).collect()) == ["ids_1", "ids_2", "ids_3", "ids_4"]
    queries = spark.createDataFrame([(1, "do dogs bark?", None, None), (2, "", None, None), (3, None, None, None), (4, "!", "f", None)], "query_id long, query string, field_of_study string, semester string")
    got = {r["query_id"]: r for r in pipeline.answer(spark, queries, path, "none", "sorry", k=2).collect()}
    assert set(got) == {1, 4}
    assert got[1]["answer"] == "dogs bark" and got[1]["sources"] == ["Unknown", "Unknown"]
    assert got[4]["answer"] == "none" and got[4]["sources"] == []


def test_streaming_ingest(spark, tmp_path):
    folder = tmp_path / "facts"
    folder.mkdir()
    (folder / "a.json").write_text('[{"source": "s", "fact": "f"}, {"source": "s", "fact": "g"}]')
    args = (spark, str(folder), str(tmp_path / "index"), str(tmp_path / "state"))
    assert stream_facts(*args).awaitTermination(60)
    (folder / "b.json").write_text('[{"source": "s", "fact": "g"}, {"fact": "h"}, {"fact": ""}]')
    assert stream_facts(*args).awaitTermination(60)
    got = index.open_index(spark, str(tmp_path / "index"))
    assert sorted((r["id"], r["document"]) for r in got.collect()) == [("ids_1", "f"), ("ids_2", "g"), ("ids_3", "h")]
    assert got.select(F.max(F.size("embedding"))).first()[0] == 64
    index.append_index(got.selectExpr("url source", "document fact", "embedding"), str(tmp_path / "index"), [F.col("fact")])  # rows without keys
    (folder / "c.json").write_text('[{"fact": "h"}, {"fact": "i"}]')
    assert stream_facts(*args).awaitTermination(60)
    assert sorted(r["document"] for r in index.open_index(spark, str(tmp_path / "index")).collect()) == ["f", "f", "g", "g", "h", "h", "i"]


def test_sinks(spark, tmp_path):
    from quaestor.sources import sinks

    facts = spark.createDataFrame([("a.txt", 0, 1, None, "y"), ("a.txt", 0, 0, "s", "x"), ("b.txt", 1, 0, "s", "z")], "file string, chunk_no int, pos int, source string, fact string")
    path = str(tmp_path / "facts")
    for rows_ in (facts, facts.where("file = 'a.txt'")):
        sinks.write_facts(rows_, path)
    assert rows(spark.read.parquet(path), "pos") == [("a_facts.json", 0, 0, "s", "x"), ("a_facts.json", 0, 1, None, "y")]
    sinks.write_facts(facts.where("file = 'b.txt'").withColumn("file", F.lit("b.docx.txt")), path)
    assert rows(spark.read.parquet(path)) == [("b.docx_facts.json", 1, 0, "s", "z")]  # one extension goes
    pages_ = spark.createDataFrame([(1, "https://a", "x#y"), (2, "https://a/", "z")], "page_id long, url string, text string")
    sinks.write_pages(pages_, path, "#", "!")
    assert rows(spark.read.parquet(path)) == [("a.txt", "URL: https://a/\n\nz")]
    office = spark.createDataFrame([("a", "t", "u", None), ("b", None, "u", "bad")], "file string, text string, source_url string, error string")
    sinks.write_processed(office, path)
    assert rows(spark.read.parquet(path)) == [("a", "t", "u")]
