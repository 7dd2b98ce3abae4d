"""A data source of files in a folder: one row a file, its text read within bounds, and an error where it could not be read.

    spark.dataSource.register(FolderSource)
    spark.read.format("folder").option("path", "/library").load()

The driver lists the upper two levels of folders; every folder below is a partition that a task walks by itself. Nothing that a
file holds, or that a folder refuses, ends the read: it becomes a row with `error`.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, rel_path string, folder string, filename string, ext string, size_bytes long, modified timestamp, file_class string, sha256 string, text string, cut boolean, error string"

#: Bounds of what is read of a file, kinds of files by extension, names that are never listed.
BOUNDS = {"text_bytes": 200_000, "sheets": 12, "sheet_rows": 60, "paragraphs": 400, "tables": 10, "table_rows": 40, "hash_mb": 64, "xml_bytes": 50_000_000}
CLASSES = {
    "pdf": ".pdf", "excel": ".xlsx .xlsm .xls", "word": ".docx .doc", "image": ".jpg .jpeg .png .gif .tif .tiff .bmp .heic", "video": ".mp4 .mov .avi .mkv",
    "audio": ".mp3 .wav .m4a", "archive": ".zip .rar .7z .gz .tar", "cad": ".dwg .dxf .rvt .ifc", "text": ".txt .csv .md .json .jsonl .xml .html .htm .log .tsv",
}
SKIPPED = {"$RECYCLE.BIN", "System Volume Information", ".Trashes", ".DS_Store", "Thumbs.db", "desktop.ini"}
LEGACY = {".xls", ".doc"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_class(ext: str) -> str:
    return next((k for k, names in CLASSES.items() if ext in names.split()), "other")


def digest(path: str, most: int) -> str:
    """sha256 of the file, or `partial:` and that of its first `most` bytes where it is larger."""
    h, left = hashlib.sha256(), most
    with open(path, "rb") as f:
        while left and (block := f.read(min(left, 1 << 20))):
            h.update(block)
            left -= len(block)
        return h.hexdigest() if not f.read(1) else "partial:" + h.hexdigest()


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


class Bounded:
    """A stream that ends after `most` bytes; a document cut by it is an error of its own kind."""

    def __init__(self, stream, most: int):
        self.stream, self.left = stream, most

    def read(self, n: int = -1) -> bytes:
        if self.left <= 0:
            raise ValueError("more XML than the bound allows")
        out = self.stream.read(min(n, self.left) if n >= 0 else self.left)
        self.left -= len(out)
        return out


def read_plain(path: str, bounds: dict) -> tuple[str, bool]:
    with open(path, "rb") as f:
        raw = f.read(bounds["text_bytes"] + 1)
    return raw[: bounds["text_bytes"]].decode("utf-8", "replace"), len(raw) > bounds["text_bytes"]


def read_sheets(path: str, bounds: dict) -> tuple[str, bool]:
    """The first rows of the first sheets, cells parted by tabs."""
    with zipfile.ZipFile(path) as z:
        names = sorted((n for n in z.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=lambda n: (len(n), n))
        wanted: list[list[list[tuple[str, str]]]] = []
        cut = len(names) > bounds["sheets"]
        for name in names[: bounds["sheets"]]:
            rows: list[list[tuple[str, str]]] = []
            with z.open(name) as f:
                for _, e in ElementTree.iterparse(Bounded(f, bounds["xml_bytes"])):
                    if _plain(e.tag) != "row":
                        continue
                    if len(rows) == bounds["sheet_rows"]:
                        cut = True
                        break
                    rows.append([(c.get("t", "n"), "".join(x.text or "" for x in c.iter() if _plain(x.tag) in ("v", "t"))) for c in e if _plain(c.tag) == "c"])
                    e.clear()
            wanted.append(rows)
        needed = {int(v) for rows in wanted for row in rows for t, v in row if t == "s" and v.isdigit()}
        shared: dict[int, str] = {}
        if needed and "xl/sharedStrings.xml" in z.namelist():
            at = 0
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(Bounded(f, bounds["xml_bytes"])):
                    if _plain(e.tag) == "si":
                        if at in needed:
                            shared[at] = "".join(x.text or "" for x in e.iter() if _plain(x.tag) == "t")
                        at += 1
                        e.clear()
                        if at > max(needed):
                            break
    value = lambda t, v: shared.get(int(v), "") if t == "s" and v.isdigit() else v
    return "\n".join("\t".join(value(t, v) for t, v in row) for rows in wanted for row in rows), cut


def read_document(path: str, bounds: dict) -> tuple[str, bool]:
    """The first paragraphs and, of the first tables, the first rows, in order; cells parted by tabs."""
    out, n, tables, depth, cut = [], 0, 0, 0, False
    with zipfile.ZipFile(path) as z, z.open("word/document.xml") as f:
        for event, e in ElementTree.iterparse(Bounded(f, bounds["xml_bytes"]), events=("start", "end")):
            if e.tag == _W + "tbl":
                depth += 1 if event == "start" else -1
                if event == "end" and not depth:
                    tables += 1
                    if tables > bounds["tables"]:
                        cut = True
                    else:
                        rows = [r for r in e if r.tag == _W + "tr"]
                        cut |= len(rows) > bounds["table_rows"]
                        out += ["\t".join("".join(t.text or "" for t in c.iter(_W + "t")) for c in r if c.tag == _W + "tc") for r in rows[: bounds["table_rows"]]]
                    e.clear()
            elif e.tag == _W + "p" and event == "end" and not depth:
                n += 1
                if n > bounds["paragraphs"]:
                    cut = True
                    break
                out.append("".join(t.text or "" for t in e.iter(_W + "t")))
                e.clear()
    return "\n".join(out), cut


READERS = {"text": read_plain, "excel": read_sheets, "word": read_document}


def one_file(root: str, path: str, bounds: dict) -> tuple:
    """The row of one file; what goes wrong is told in its `error`."""
    row = _named(root, path)
    try:
        if os.path.islink(path):
            return _row(row, error="link not followed")
        stat = os.stat(path)
        row |= {"size_bytes": stat.st_size, "modified": datetime.fromtimestamp(stat.st_mtime, UTC), "file_class": file_class(row["ext"])}
        if not stat.st_size:
            return _row(row, error="zero-byte file")
        row["sha256"] = digest(path, bounds["hash_mb"] << 20)
        if row["ext"] in LEGACY:
            return _row(row, error="legacy binary format, text not read")
        if row["file_class"] == "pdf":
            return _row(row, error="no reader for this kind of file")
        if row["file_class"] in READERS:
            row["text"], row["cut"] = READERS[row["file_class"]](path, bounds)
        return _row(row)
    except Exception as e:  # one file never ends the read
        return _row(row, error=f"{type(e).__name__}: {e}"[:300])


def _named(root: str, path: str) -> dict:
    clean = lambda s: s.encode("utf-8", "replace").decode()
    rel = os.path.relpath(path, root)
    return {"path": clean(path), "rel_path": clean(rel), "folder": clean(os.path.dirname(rel)), "filename": clean(os.path.basename(path)), "ext": clean(os.path.splitext(path)[1].lower())}


def _row(values: dict, error: str | None = None) -> tuple:
    return tuple((values | {"error": error}).get(c.split()[0]) for c in SCHEMA.split(", "))


def _folder_row(root: str, path: str, error: str) -> tuple:
    return _row(_named(root, path) | {"ext": "", "file_class": "directory"}, error)


def children(root: str, path: str, excluded: list[str]) -> tuple[list[str], list[str], list[tuple]]:
    """Folders to walk, files to read and rows to give out for what is not walked, of one folder, by name."""
    folders, files, rows = [], [], []
    try:
        entries = sorted(os.scandir(path), key=lambda e: e.name)
    except OSError as e:
        return [], [], [_folder_row(root, path, f"folder not readable, {type(e).__name__}: {e}"[:300])]
    for e in entries:
        if e.name in SKIPPED or any(fnmatch.fnmatch(e.name.lower(), p) for p in excluded):
            continue
        if e.is_dir(follow_symlinks=False):
            if e.name.startswith("."):
                rows.append(_folder_row(root, e.path, "hidden folder not walked"))
            else:
                folders.append(e.path)
        elif e.is_symlink() and os.path.isdir(e.path):
            rows.append(_folder_row(root, e.path, "link not followed"))
        elif not e.name.startswith(("._", "~$")):
            files.append(e.path)
    return folders, files, rows


@dataclass
class Part(InputPartition):
    """A folder: its whole subtree, or its own files only."""

    path: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.excluded = [p.strip().lower() for p in options.get("exclude", "").split(",") if p.strip()]
        self.bounds = {k: int(options.get(k, v)) for k, v in BOUNDS.items()}

    def partitions(self) -> list[Part]:
        out = [Part(self.root, False)]
        for top in children(self.root, self.root, self.excluded)[0]:
            out.append(Part(top, False))
            out += [Part(p, True) for p in children(self.root, top, self.excluded)[0]]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            folders, files, rows = children(self.root, todo.pop(), self.excluded)
            yield from rows
            yield from (one_file(self.root, f, self.bounds) for f in files)
            if partition.deep:
                todo += folders


class FolderSource(DataSource):
    """Options: path; exclude (name patterns, comma-parted, any case); and the bounds of BOUNDS by name."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        if "path" not in self.options:
            raise ValueError("the folder source needs a path")
        return FolderReader({k: self.options[k] for k in ("path", "exclude", *BOUNDS) if k in self.options})
