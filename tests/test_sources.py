"""Readers and writers on real folders: bounded files, logs, registries, shapes, exports."""

import hashlib
import json
import os
import zipfile

import pytest

from spandrel.sources import sinks, tables
from spandrel.sources.folder import FolderSource

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def xlsx(path, sheets, rows):
    cells = "".join(f'<row><c t="s"><v>{r % 3}</v></c><c><v>{r}</v></c><c t="inlineStr"><is><t>x{r}</t></is></c></row>' for r in range(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in ("one", "two", "three")) + "</sst>")
        for k in range(1, sheets + 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")


def docx(path, paragraphs, tables_, rows):
    p = "".join(f"<w:p><w:r><w:t>p{i}</w:t></w:r></w:p>" for i in range(paragraphs))
    t = "<w:tbl>" + "".join(f"<w:tr><w:tc><w:p><w:r><w:t>a{i}</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>" for i in range(rows)) + "</w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{t * tables_}{p}</w:body></w:document>')


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    for d in ("a/b/c", "d", ".hidden", "a/skip me", "e/f"):
        (root / d).mkdir(parents=True)
    (root / "note.txt").write_bytes(b"ok \xff text")
    (root / "a/long.csv").write_bytes(b"x" * 200_001)
    (root / "a/b/c/empty.txt").write_bytes(b"")
    (root / "a/b/broken.xlsx").write_bytes(b"PK no zip")
    (root / "d/old.doc").write_bytes(b"\xd0\xcf")
    (root / "d/scan.pdf").write_bytes(b"%PDF-1.4")
    (root / "d/photo.JPG").write_bytes(b"\xff\xd8")
    (root / "d/~$lock.txt").write_bytes(b"no")
    (root / "a/skip me/x.txt").write_bytes(b"no")
    (root / ".hidden/x.txt").write_bytes(b"no")
    xlsx(root / "e/book.xlsx", 14, 70)
    docx(root / "e/f/text.docx", 405, 11, 45)
    with zipfile.ZipFile(root / "e/none.docx", "w") as z:
        z.writestr("other.xml", "<a/>")
    os.symlink(root, root / "d/loop")
    os.symlink(root / "gone.txt", root / "d/dead.txt")
    return root


def test_folder_source(spark, library):
    spark.dataSource.register(FolderSource)
    df = spark.read.format("folder").option("path", str(library)).option("exclude", "SKIP*").load()
    got = {r.rel_path: r for r in df.collect()}
    assert set(got) == {"note.txt", "a/long.csv", "a/b/c/empty.txt", "a/b/broken.xlsx", "d/old.doc", "d/scan.pdf", "d/photo.JPG", ".hidden", "e/book.xlsx", "e/f/text.docx", "e/none.docx", "d/loop", "d/dead.txt"}
    assert {p: r.error for p, r in got.items() if r.error and ":" not in r.error} == {
        "a/b/c/empty.txt": "zero-byte file", "d/old.doc": "legacy binary format, text not read", "d/scan.pdf": "no reader for this kind of file", ".hidden": "hidden folder not walked", "d/loop": "link not followed", "d/dead.txt": "link not followed",
    }
    assert got["a/b/broken.xlsx"].error.startswith("BadZipFile") and got["e/none.docx"].error.startswith("KeyError")
    assert got["note.txt"].text == "ok � text" and got["note.txt"].cut is False and got["note.txt"].sha256 == hashlib.sha256(b"ok \xff text").hexdigest()
    assert len(got["a/long.csv"].text) == 200_000 and got["a/long.csv"].cut
    lines = got["e/book.xlsx"].text.split("\n")
    assert len(lines) == 12 * 60 and lines[:2] == ["one\t0\tx0", "two\t1\tx1"] and got["e/book.xlsx"].cut
    lines = got["e/f/text.docx"].text.split("\n")
    assert len(lines) == 10 * 40 + 400 and lines[0] == "a0\tb" and lines[-1] == "p399"
    assert got["d/photo.JPG"].file_class == "image" and got["d/photo.JPG"].text is None and got["d/photo.JPG"].error is None


def test_folder_bounds_and_missing_path(spark, library):
    spark.dataSource.register(FolderSource)
    small = spark.read.format("folder").option("path", str(library)).option("text_bytes", 4).option("hash_mb", 0).option("xml_bytes", 100).load()
    got = {r.rel_path: r for r in small.collect()}
    assert got["note.txt"].text == "ok �" and got["note.txt"].sha256.startswith("partial:")
    assert "bound" in got["e/book.xlsx"].error
    gone = spark.read.format("folder").option("path", str(library / "gone")).load().collect()
    assert [r.file_class for r in gone] == ["directory"] and "not readable" in gone[0].error


def test_logs_registries_and_shapes(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"url": "u", "status": "fetched"}\nnot json\n{"url": "v"}\n\n')
    assert {(r.url, r.status) for r in tables.read_log(spark, str(tmp_path / "log.jsonl"), "url string, status string").collect()} == {("u", "fetched"), ("v", None)}
    (tmp_path / "registry.json").write_text(json.dumps({"allowed_hosts": ["h"], "sources": [{"id": "1", "url": "x", "extra": 2}, {"id": "2"}]}))
    assert [(r.ord, r.id, r.url) for r in tables.read_registry(spark, str(tmp_path / "registry.json")).orderBy("ord").collect()] == [(0, "1", "x"), (1, "2", None)]
    (tmp_path / "shapes.csv").write_text("AISC_Manual_Label,Type,W,d,bf,tw,tf,A\nw8x10,W,10,7.89,3.94,0.17,0.205,2.96\nW8X10,W,10,8,–,-,0.2,2.9\nHSS4X4X1/4,HSS,12.2,–,,,,3.37\n")
    got = {r.label: (r.d, r.bf, r.tw, r.area) for r in tables.read_shapes(spark, str(tmp_path / "shapes.csv")).collect()}
    assert got == {"W8X10": (8.0, None, None, 2.9), "HSS4X4X1/4": (None, None, None, 3.37)}


def test_whole_texts_and_sniffing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"abc \xff")
    (row,) = tables.read_texts(spark, str(tmp_path / "in")).collect()
    assert row.text == "abc �" and row.length == 5 and row.sha256 == hashlib.sha256(b"abc \xff").hexdigest()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, [])], "id int, name string, list array<int>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("id").collect()
    assert [(r.id, r.name, r.list) for r in back] == [("1", "a", "[1,2]"), ("2", None, "[]")]
    sinks.write_json(df, str(tmp_path / "json"), by="id")
    assert spark.read.json(str(tmp_path / "json")).filter("id = 1").first()["list"] == [1, 2]
    for _ in range(2):
        sinks.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert sinks.markdown(df.orderBy("id"), ["id", "name"]) == "| id | name |\n|---|---|\n| 1 | a |\n| 2 |  |"


def test_later_records_win(spark):
    from spandrel.operators import resolve

    rows = spark.createDataFrame([("X1", "2018-01-01", 1), ("X1", "2019-01-01", 2), ("X1", "2019-01-01", 3), ("X2", None, 4)], "design string, last_updated string, ord int")
    assert {(r.design, r.ord) for r in resolve.latest_listing(rows).collect()} == {("X1", 3), ("X2", 4)}
