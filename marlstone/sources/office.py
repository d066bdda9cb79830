"""Office files and PDF from their bytes, with the standard library only, as rows of elements.

DOCX, PPTX and XLSX are ZIP archives of XML. Of PDF lines of text are read in order of streams; ``pdf`` and
``layout`` read pages with their layout. A file that can't be read gives one row of kind ``error``.
"""

from __future__ import annotations

import io
import mimetypes
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, place int, kind string, part int, name string, text string, cells array<array<string>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _words(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag in (_W + "tab", _W + "br"):
            out.append(" ")
    return "".join(out).strip()


def _targets(pack: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship ids of a part of an archive and the parts that they name."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in pack.namelist():
        return {}
    found = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(pack.read(rels)) if x.get("TargetMode") != "External"}
    return {k: posixpath.normpath(v.lstrip("/") if v.startswith("/") else f"{folder}/{v}") for k, v in found.items()}


def _pictures(node, targets: dict[str, str]) -> list[dict]:
    """Images that a node shows, by their parts of the archive."""
    named = [targets.get(x.get(_R + "embed", "")) for x in node.iter(_A + "blip")]
    return [{"kind": "Image", "name": x} for x in named if x]


def parse_docx(data: bytes) -> list[dict]:
    """Titles, list items, paragraphs, tables and images of the body in order; contents fields are left out."""
    pack = zipfile.ZipFile(io.BytesIO(data))
    body = ElementTree.fromstring(pack.read("word/document.xml")).find(_W + "body")
    out, targets = [], _targets(pack, "word/document.xml")
    for x in body if body is not None else ():
        if x.tag == _W + "tbl":
            cells = [[_words(c) for c in row.findall(_W + "tc")] for row in x.findall(_W + "tr")]
            width = max(map(len, cells), default=0)
            cells = [r + [""] * (width - len(r)) for r in cells]
            out.append({"kind": "Table", "cells": cells, "text": "\n".join(" | ".join(r) for r in cells)})
        elif x.tag == _W + "p" and (text := _words(x)):
            style = x.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(_W + "val", "") if style is not None else ""
            if re.match(r"(?i)toc\s*\d*", name):
                continue
            item = x.find(f"{_W}pPr/{_W}numPr") is not None
            kind = "Title" if re.match(r"(?i)(heading|title)", name) else "ListItem" if item else "NarrativeText"
            out.append({"kind": kind, "text": text, "name": name or None})
        out += _pictures(x, targets)
    return out


def _numbered(names: list[str], pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n)))


def parse_pptx(data: bytes) -> list[dict]:
    """Paragraphs, tables and images of each slide, then its notes."""
    pack = zipfile.ZipFile(io.BytesIO(data))
    out = []
    for number, name in _numbered(pack.namelist(), r"ppt/slides/slide(\d+)\.xml"):
        slide = ElementTree.fromstring(pack.read(name))
        parents = {c: p for p in slide.iter() for c in p}

        def within(x, tag, parents=parents):
            while x in parents:
                x = parents[x]
                if x.tag == tag:
                    return True
            return False

        for x in slide.iter():
            if x.tag == _A + "tbl":
                cells = [["".join(t.text or "" for t in c.iter(_A + "t")) for c in row.findall(_A + "tc")] for row in x.findall(_A + "tr")]
                out.append({"kind": "Table", "part": number, "cells": cells, "text": "\n".join(" | ".join(r) for r in cells)})
            elif x.tag == _A + "p" and not within(x, _A + "tbl"):
                text = "".join(t.text or "" for t in x.iter(_A + "t")).strip()
                if text:
                    out.append({"kind": "NarrativeText", "part": number, "text": text})
        out += [{**x, "part": number} for x in _pictures(slide, _targets(pack, name))]
        notes = f"ppt/notesSlides/notesSlide{number}.xml"
        if notes in pack.namelist():
            lines = ["".join(t.text or "" for t in p.iter(_A + "t")).strip() for p in ElementTree.fromstring(pack.read(notes)).iter(_A + "p")]
            if any(lines):
                out.append({"kind": "Notes", "part": number, "text": "\n".join(x for x in lines if x)})
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_xlsx(data: bytes, most_sheets: int | None = 20) -> list[dict]:
    """Rows of each sheet, of the first ``most_sheets`` or of all, as strings, up to its last filled cell; blank rows go."""
    pack = zipfile.ZipFile(io.BytesIO(data))
    strings = []
    if "xl/sharedStrings.xml" in pack.namelist():
        strings = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(pack.read("xl/sharedStrings.xml")).findall(_S + "si")]
    book = ElementTree.fromstring(pack.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(pack.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for number, sheet in enumerate(list(book.iter(_S + "sheet"))[:most_sheets], 1):
        target = targets[sheet.get(_R + "id")].lstrip("/")
        root = ElementTree.fromstring(pack.read(target if target.startswith("xl/") else "xl/" + target))
        rows = []
        for row in root.iter(_S + "row"):
            cells: list[str] = []
            for c in row.findall(_S + "c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                v, inline = c.find(_S + "v"), c.find(_S + "is")
                text = "".join(t.text or "" for t in inline.iter(_S + "t")) if inline is not None else (v.text or "") if v is not None else ""
                if c.get("t") == "s" and text:
                    text = strings[int(text)]
                cells += [""] * (at - len(cells)) + [text]
            if any(x.strip() for x in cells):
                rows.append(cells)
        width = max(map(len, rows), default=0)
        out.append({"kind": "Sheet", "part": number, "name": sheet.get("name"), "cells": [r + [""] * (width - len(r)) for r in rows]})
    return out


_PDF_TEXT = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|T[dDm*]|TJ|Tj|'|\"|BT|ET|-?\d+\.?\d*", re.S)
_PDF_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_PDF_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")

    def one(m):
        x = m[1]
        return _PDF_NAMED.get(x, b"" if x.strip() == b"" else bytes([int(x, 8) & 255]) if x[:1].isdigit() else x)

    return _PDF_ESCAPE.sub(one, raw[1:-1]).decode("latin-1")


def parse_pdf(data: bytes) -> list[dict]:
    """Lines of text of the content streams, numbered by stream."""
    if not data.startswith(b"%PDF"):
        raise ValueError("no PDF")
    out, part = [], 0
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n", data, re.S):
        end = data.find(b"endstream", m.end())
        body = data[m.end() : end if end >= 0 else len(data)].rstrip(b"\r\n")
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body or not re.search(rb"Tj|TJ|'|\"", body):
            continue
        part += 1
        lines, now, held = [], "", []
        for token in _PDF_TEXT.findall(body):
            if token[:1] in b"(<":
                held.append(_pdf_string(token))
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"') and now:
                    lines.append(now)
                    now = ""
                now += "".join(held)
                held = []
            elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                if now.strip():
                    lines.append(now)
                now, held = "", []
        out += [{"kind": "NarrativeText", "part": part, "text": x.strip()} for x in lines + [now] if x.strip()]
    return out


PARSERS = {"docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "xlsm": parse_xlsx, "pdf": parse_pdf}


def parsed_files(files: DataFrame, most_sheets: int | None = 20) -> DataFrame:
    """(path, place, kind, part, name, text, cells) of files (path, content) of known extensions; part is a slide, sheet or stream.

    Of a workbook the first ``most_sheets`` are read, or all with None. An image's name is its part of the archive.
    """
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                parse = PARSERS.get(path.rsplit(".", 1)[-1].lower())
                if parse is None:
                    continue
                try:
                    found = parse(bytes(content or b""), most_sheets) if parse is parse_xlsx else parse(bytes(content or b""))
                except Exception as e:  # noqa: BLE001
                    found = [{"kind": "error", "text": f"{type(e).__name__}: {e}"}]
                rows = [{"path": path, "place": k, "part": None, "name": None, "text": None, "cells": None, **x} for k, x in enumerate(found)]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"part": "Int32"})

    return files.select("path", "content").mapInPandas(run, _SCHEMA)


def images(files: DataFrame) -> DataFrame:
    """(path, name, media_type, content) of the images in the archives (path, content) of documents and presentations; their places are those of the elements of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("path", pa.string()), ("name", pa.string()), ("media_type", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    pack = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                for name in pack.namelist():
                    if re.match(r"(?:word|ppt|xl)/media/[^/]+$", name):  # one at a time, as they are large
                        row = {"path": path, "name": name, "media_type": mimetypes.guess_type(name)[0], "content": pack.read(name)}
                        yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return files.select("path", "content").mapInArrow(run, "path string, name string, media_type string, content binary")


def read_office(spark: SparkSession, path: str, most_sheets: int | None = 20) -> DataFrame:
    """Elements of all office files and PDFs below a path, of any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(PARSERS) + "}").load(path)
    return parsed_files(files.select("path", "content"), most_sheets)


def catalogued(files: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New files (path, content) by their SHA-256, and those the catalog (hash) has already; of equal new files the first path counts."""
    from pyspark.sql import Window

    hashed = files.withColumn("hash", F.sha2("content", 256)).withColumn("size", F.octet_length("content").cast("long"))
    known = hashed.join(catalog.select("hash").distinct(), "hash", "left_semi")
    fresh = hashed.join(catalog.select("hash").distinct(), "hash", "left_anti")
    first = F.row_number().over(Window.partitionBy("hash").orderBy("path"))
    return fresh.withColumn("_n", first).where("_n = 1").drop("_n"), known
