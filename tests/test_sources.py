"""Parsers, readers, sinks, streams."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chunkloom.operators.splitters import SentenceSplitter
from chunkloom.plans import pipeline
from chunkloom.schemas import QA
from chunkloom.sources import parsers, readers, sinks
from chunkloom.streaming import stream


def consistent(doc: dict) -> None:
    assert "".join(p["text"] for p in doc["pages"]) == doc["full_text"]
    assert doc["split_points"] == sorted(doc["split_points"]) and all(0 < p < len(doc["full_text"]) for p in doc["split_points"])
    for t in doc["titles"]:
        assert doc["full_text"][t["start"] :].startswith(t["title"]) and t["start"] < t["end"] <= len(doc["full_text"])


def paragraph(text, page, role=None):
    return {"content": text, "role": role, "boundingRegions": [{"pageNumber": page}]}


def test_layout_parser():
    raw = {
        "pages": [{}, {}, {}],
        "paragraphs": [paragraph("Head", 1, "pageHeader"), paragraph("Big", 1, "title"), paragraph("short one", 1), paragraph("short two", 1), paragraph("Part", 2, "sectionHeading"), paragraph("note", 2, "footnote"), paragraph("foot", 1, "pageFooter"), paragraph("1", 1, "pageNumber")],
        "tables": [{"rowCount": 2, "columnCount": 2, "cells": [{"rowIndex": 0, "columnIndex": 0, "content": "a"}, {"rowIndex": 1, "columnIndex": 1, "content": "b"}], "caption": {"content": "cap"}, "boundingRegions": [{"pageNumber": 2}]}],
        "figures": [{"boundingRegions": [{"pageNumber": 2}]}, {"caption": {"content": "fig"}, "boundingRegions": [{"pageNumber": 2}]}],
        "sections": [{"elements": ["/paragraphs/1", "/paragraphs/2", "/paragraphs/3", "/sections/1", "/paragraphs/99", "/nonsense"]}, {"elements": ["/paragraphs/4", "/tables/0", "/figures/0", "/figures/1", "/paragraphs/5", "/sections/0"]}],
    }
    doc = parsers.LayoutParser().convert(json.dumps(raw))
    consistent(doc)
    assert [p["page"] for p in doc["pages"]] == [1, 2, 3] and doc["pages"][2]["text"] == ""
    assert doc["pages"][0]["text"] == "<!-- PageHeader: Head -->\n\n# Big\n\nshort one\n\nshort two\n\n<!-- PageFooter: foot page 1 -->\n<!-- PageBreak -->\n\n"
    assert "<Table>" in doc["full_text"] and "cap" in doc["full_text"] and doc["full_text"].count("<Figure>") == 1 and "\\* note" in doc["full_text"]
    assert [(t["title"], t["level"]) for t in doc["titles"]] == [("# Big", 1), ("## Part", 2)]
    big = doc["full_text"].index("# Big")
    assert big + len("# Big\n\n") not in doc["split_points"] and doc["full_text"].index("short two") not in doc["split_points"]
    with pytest.raises(RuntimeError, match="service"):
        parsers.LayoutParser().scan(b"")


def test_items_and_pages_parsers():
    items = [{"label": "title", "text": "T", "page": 1}, {"label": "text", "text": "word " * 120, "page": 1}, {"label": "table", "text": "| a |\n|---|\n" + "| x y z |\n" * 30, "page": 2}, {"label": "footnote", "text": "f", "page": 2}]
    doc = parsers.ItemsParser(most=30).convert(json.dumps(items))
    consistent(doc)
    assert doc["full_text"].count("<Table>") > 1 and doc["full_text"].count("| a |") == doc["full_text"].count("<Table>")
    doc = parsers.PagesParser().convert(json.dumps([{"text": "# A\ntext\n## B\nmore\n"}, "# C\nend\n"]))
    consistent(doc)
    assert [(t["title"], t["level"]) for t in doc["titles"]] == [("# A", 1), ("## B", 2), ("# C", 1)] and doc["split_points"] == [len(doc["pages"][0]["text"])]
    assert doc["titles"][0]["end"] == doc["titles"][2]["start"] == doc["titles"][1]["end"]


def test_small_tables_stay_whole():
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    assert parsers.split_table_text(table, 1000) == [table]


def test_headers():
    assert parsers.clean_header(["a", "", "a", "nan"], 5) == ["a", "col_1", "a_1", "col_3", "col_4"]


def workbook() -> bytes:
    rows = lambda rs: "".join(f'<row r="{n}">' + "".join(f'<c r="{c}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in cells) + "</row>" for n, cells in rs)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"<worksheet {ns}><sheetData>{rows([(1, [('A', 'name'), ('B', 'size')]), (2, [('A', 'x'), ('B', '1')]), (4, [('B', 'other')]), (5, [('B', '7')])])}</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml" Type="t"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_excel():
    parser = parsers.ExcelParser()
    doc = parser.convert(parser.scan(workbook()))
    consistent(doc)
    assert doc["full_text"].startswith("# S\n\n| name | size |\n| --- | --- |\n| x | 1 |") and "| col_0 | other |" in doc["full_text"] and len(doc["titles"]) == 2


def test_html():
    doc = parsers.HtmlPageParser().convert("<body><nav>menu</nav><h1>A</h1><p>one &amp; two</p><hr><h2>B</h2><ul><li>x<li>y</ul><table><tr><th>k<td>v</tr></table><script>no</script>")
    consistent(doc)
    assert [p["page"] for p in doc["pages"]] == [1, 2] and "menu" not in doc["full_text"] and "one & two" in doc["full_text"] and "| k | v |" in doc["full_text"]


def test_parse_directory_skips_done_and_keeps_errors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "sub" / "b.xlsx").write_bytes(b"broken")
    got = {r["doc_name"]: r["error"] for r in parsers.parse_directory(spark, str(tmp_path), parsers.ExcelParser).collect()}
    assert got["a"] is None and "BadZipFile" in got["b"]
    done = spark.createDataFrame([("a",)], "doc_name string")
    assert [r["doc_name"] for r in parsers.parse_directory(spark, str(tmp_path), parsers.ExcelParser, done).collect()] == ["b"]


def parsed(name="x"):
    return {"document_name": name, "pages": {"1": "# T\n" + "alpha beta. " * 50, "2": "gamma delta. " * 50}, "full_text": "# T\n" + "alpha beta. " * 50 + "gamma delta. " * 50, "split_points": [604], "titles": [{"title": "# T", "start": 0, "end": 1254, "level": 1}]}


def test_chunk_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "dom_doc.json").write_text(json.dumps(parsed()))
    found = pipeline.chunk_files(spark, str(tmp_path / "in"), chunk_size=60, chunk_overlap=0, min_chunk_tokens=10, output=str(tmp_path / "out")).orderBy("chunk_index").collect()
    assert "".join(r["chunk_text"] for r in found) == parsed()["full_text"] and found[0]["doc_name"] == "dom_doc" and found[0]["titles_context"] == "" and found[-1]["titles_context"] == "# T"
    assert found[0]["chunk_pages"] == [1] and found[-1]["chunk_pages"] == [2]
    one = pipeline.chunk_files(spark, str(tmp_path / "in" / "dom_doc.json"))
    assert one.count() >= 1
    with pytest.raises(FileNotFoundError):
        pipeline.chunk_files(spark, str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    frame = lambda rows: spark.createDataFrame(rows, "doc_name string, method string, n int")
    sinks.write_methods(frame([("d", "a", 1), ("d", "b", 1), ("d", "c", 1)]), path)
    sinks.write_methods(frame([("d", "b", 2)]), path, ["b", "c"])
    assert {(r["method"], r["n"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}
    metric = lambda rows: spark.createDataFrame(rows, "doc_name string, chunking_method string, metric_name string, score double")
    sinks.append_metrics(metric([("d", "a", "m", 1.0)]), str(tmp_path / "m"))
    assert sinks.append_metrics(metric([("d", "a", "m", 9.0), ("d", "b", "m", 2.0)]), str(tmp_path / "m")).agg(F.sum("score")).first()[0] == 3.0
    docs = spark.createDataFrame([("d", 1)], "doc_name string, n int")
    sinks.append_documents(docs, str(tmp_path / "docs"))
    assert sinks.append_documents(docs, str(tmp_path / "docs")).count() == 1
    qa = spark.createDataFrame([(1, "d", "q", "a")], QA)
    sinks.write_json(qa, str(tmp_path / "qa"), by="doc_name")
    assert readers.records(spark, str(tmp_path / "qa"), QA).count() == 1
    assert readers.mentions_folder(spark, str(tmp_path / "nope"), str(tmp_path / "m")) == str(tmp_path / "m") and readers.mentions_folder(spark, str(tmp_path / "nope"), str(tmp_path / "nope2")) is None


def test_query_csv_and_best_chunks(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Id;English Question\n1;What?\n2;Why; not\n")
    assert [r[0] for r in readers.queries_csv(spark, str(tmp_path / "q.csv")).collect()] == ["What?", "Why"]
    (tmp_path / "best").mkdir()
    (tmp_path / "best" / "d.json").write_text(json.dumps({"doc_name": "d", "method": "m", "chunks": [{"chunk_text": "a", "titles_context": "", "chunk_pages": [1]}, {"chunk_text": "b", "titles_context": "", "chunk_pages": [2]}]}))
    assert [(r["chunk_id"], r["text"]) for r in readers.best_chunks(spark, str(tmp_path / "best")).orderBy("chunk_id").collect()] == [(0, "a"), (1, "b")]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    source = stream.document_stream(spark, str(tmp_path / "in"), 1)
    query = stream.write_chunks(stream.chunk_stream(source, SentenceSplitter("lines"), "lines"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    want = pipeline.split_documents(readers.from_table(docs), {"lines": SentenceSplitter("lines")}).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want
