"""Files, streams and history."""

from __future__ import annotations

import datetime
import json
import zipfile

from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
X = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def corpus(folder):
    (folder / "sub").mkdir()
    (folder / "a.txt").write_bytes("héllo wörld".encode("latin-1"))
    (folder / "sub" / "b_id.md").write_text("tęxt", encoding="utf-8")
    (folder / "blank.txt").write_text("  \n")
    (folder / "skip.bin").write_bytes(b"x")
    (folder / "z.pdf").write_bytes(b"%PDF")
    (folder / "broken.docx").write_bytes(b"no zip")
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    write(folder / "c.docx", {"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t> One </w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell("x")}{cell("y")}</w:tr></w:tbl><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'})
    write(folder / "d.xlsx", {
        "xl/workbook.xml": f'<workbook xmlns="{X}" xmlns:r="{R}"><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{X}"><si><t>alpha</t></si></sst>',
        "xl/worksheets/s1.xml": f'<worksheet xmlns="{X}"><sheetData><row><c t="s"><v>0</v></c><c/><c><v>7</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    })


def test_directory(spark, tmp_path):
    corpus(tmp_path)
    rows = files.documents(spark, str(tmp_path), name_terms=False).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["file_name"]) for r in rows] == [(0, "a.txt"), (1, "c.docx"), (2, "d.xlsx"), (3, "b_id.md")]
    assert [r["text"] for r in rows] == ["héllo wörld", "One\nTwo\nx | y", "[Sheet: S1]\nalpha | 7\nin", "tęxt"]
    named = {r["file_name"]: r["text"] for r in files.documents(spark, str(tmp_path)).collect()}
    assert named["b_id.md"].startswith("tęxt\n\nb id identity card student")
    with_pdf = files.documents(spark, str(tmp_path), {"pdf": lambda b: ("pages", [{"page_num": 1, "text": "pages"}], {})}, False)
    assert with_pdf.where("file_type = 'pdf'").first()["pages"][0]["page_num"] == 1
    assert files.documents(spark, str(tmp_path / "absent")).count() == 0


def test_pages_and_words():
    assert files.paged(["long enough text of a page", "x"], lambda n: f"scan {n}")[0] == "long enough text of a page\n\nscan 2"
    assert files.recognised([("a", 90.0), (" ", -1), ("b", -1), ("c", 70.0)]) == ("a b c", {"avg_confidence": "80.0", "word_count": "3"})


def test_json_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query": "x y", "relevant_docs": ["A_b.pdf", "c.docx"]}, {"query": "z", "relevant_docs": []}]))
    assert sorted((r["query"], r["name"]) for r in files.judgments(spark, str(tmp_path / "q.json")).where("name is not null").collect()) == [("x y", "a b"), ("x y", "c")]
    (tmp_path / "s.json").write_text('{"en": {"a": ["b"]}}')
    assert files.synonyms(spark, str(tmp_path / "s.json")) == {"en": {"a": ["b"]}} and files.synonyms(spark, str(tmp_path / "none.json")) == {}


def test_streaming_index(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(0, "network of security"), (1, "network")], "doc_id long, text string").write.parquet(str(source))
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(str(source))
    ingest.index_stream(stream(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(2, "security")], "doc_id long, text string").write.mode("append").parquet(str(source))
    ingest.index_stream(stream(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted((r["doc_id"], r["pos"], r["term"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0, "network"), (0, 2, "security"), (1, 0, "network"), (2, 0, "security")]
    query = ingest.frequencies(stream()).writeStream.format("memory").queryName("df").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["term"]: r["df"] for r in spark.table("df").collect()} == {"network": 2, "security": 2}


def test_streamed_frequencies_are_exact(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('network network', if(id % 3 = 0, ' security', '')) as text")
    assert {r["term"]: r["df"] for r in ingest.frequencies(docs).collect()} == {"network": 5000, "security": 1667}


def test_history(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(i, 1, a, at(i)) for i, a in enumerate("aabba")]
    got = ingest.collapsed(spark.createDataFrame(rows, "event_id long, user_id long, action string, ts timestamp"), 2)
    assert sorted((r["event_id"], r["place"]) for r in got.collect()) == [(3, 2), (4, 1)]
    assert got.select(F.max("place")).first()[0] == 2
