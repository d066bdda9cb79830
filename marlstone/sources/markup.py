"""Structure of Markdown, HTML and plain texts as rows: blocks with heading paths, links, tables, lists, contents.

A document is parsed on its own, so parsers run in Arrow batches; what follows from rows stays in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.deal import dealt

_BLOCKS = "place int, kind string, level int, text string, line_start int, line_end int, path array<string>, cells array<array<string>>, url string"
#: Rows of blocks that a worker hands on at a time, about.
ROWS_A_TIME = 2000
_EMPTY = {"level": None, "text": "", "line_start": None, "line_end": None, "path": [], "cells": None, "url": None}


def _rows(docs: DataFrame, key: str, text: str, parse: Callable[[str], list[dict]], *more: str) -> DataFrame:
    kind = dict(docs.dtypes)[key]
    names = [key, *(c.split()[0] for c in _BLOCKS.split(", "))]

    def shaped(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"level": "Int32", "line_start": "Int32", "line_end": "Int32"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        for frame in frames:
            for k, *given in zip(frame[key], *(frame[c] for c in (text, *more))):
                found = parse(*[x or "" for x in given])
                out += [{key: k, "place": n, **_EMPTY, **b} for n, b in enumerate(found)]
                if len(out) >= ROWS_A_TIME:
                    yield shaped(out)
                    out = []
        yield shaped(out)

    # a small table can hold very many texts in one partition
    return dealt(docs.select(key, text, *more), key).mapInPandas(run, f"{key} {kind}, {_BLOCKS}")


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$")
_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_ITEM = re.compile(r"^\s*([-*+]|\d+[.)])\s+(.*)$")


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def parse_markdown(text: str) -> list[dict]:
    """Blocks in order: heading, code, table, list and paragraph, each with the path of headings that it stands under."""
    lines = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out, path, at = [], [], 0
    while at < len(lines):
        line, start = lines[at], at
        at += 1
        block: dict = {}
        if not line.strip():
            continue
        if m := _FENCE.match(line):
            while at < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[at]):
                at += 1
            block = {"kind": "code", "text": "\n".join(lines[start + 1 : at]), "url": m[2].strip() or None}
            at = min(at + 1, len(lines))
        elif m := _HEADING.match(line):
            block = {"kind": "heading", "level": len(m[1]), "text": (m[2] or "").strip()}
        elif "|" in line and at < len(lines) and "-" in lines[at] and _RULE.match(lines[at]):
            head, rows = _cells(line), []
            at += 1
            while at < len(lines) and "|" in lines[at] and lines[at].strip():
                rows.append((_cells(lines[at]) + [""] * len(head))[: len(head)])
                at += 1
            block = {"kind": "table", "text": "\n".join(lines[start:at]), "cells": [head, *rows]}
        elif _ITEM.match(line):
            while at < len(lines) and lines[at].strip() and not _HEADING.match(lines[at]):
                at += 1
            block = {"kind": "list", "text": "\n".join(x.strip() for x in lines[start:at])}
        else:
            while at < len(lines) and lines[at].strip() and not any(p.match(lines[at]) for p in (_FENCE, _HEADING, _ITEM)):
                if re.match(r"^ {0,3}(=+|-+)\s*$", lines[at]):
                    block = {"kind": "heading", "level": 1 if "=" in lines[at] else 2, "text": " ".join(x.strip() for x in lines[start:at])}
                    at += 1
                    break
                at += 1
            block = block or {"kind": "paragraph", "text": "\n".join(x.strip() for x in lines[start:at])}
        if block["kind"] == "heading":
            path = path[: block["level"] - 1] + [block["text"]]
        out.append({**block, "line_start": start + 1, "line_end": at, "path": list(path)})
    return out


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, kind, level, text, line_start, line_end, path, cells, url) of every block; null texts have none."""
    return _rows(docs, key, text, parse_markdown)


_ENDED = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}


class _Page(HTMLParser):
    """Headings, links, tables, lists and images in page order."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.path, self.open, self.skip = base, [], [], [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "base" and a.get("href"):
            self.base = urljoin(self.base, a["href"])
        elif re.fullmatch("h[1-6]|title|a|table|tr|td|th|ul|ol|dl|li|dt|dd", tag):
            inner = _ENDED.get(tag)
            if inner:  # an element of the kind ends one that is still open
                while self.open and self.open[-1]["tag"] in inner:
                    self._close(self.open[-1]["tag"])
            self.open.append({"tag": tag, "text": [], "href": a.get("href"), "rows": [], "items": []})
        elif tag == "img" and a.get("src"):
            self.out.append({"kind": "image", "text": a.get("alt") or "", "url": urljoin(self.base, a["src"])})
        elif tag == "br":
            self.handle_data(" ")

    def handle_data(self, data):
        if not self.skip:
            for x in self.open:
                x["text"].append(data)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif any(x["tag"] == tag for x in self.open):
            while self.open[-1]["tag"] != tag:
                self._close(self.open[-1]["tag"])
            self._close(tag)

    def close(self):
        super().close()
        while self.open:
            self._close(self.open[-1]["tag"])

    def _close(self, tag):
        x = self.open.pop()
        text = " ".join("".join(x["text"]).split())
        holder = lambda *tags: next((o for o in reversed(self.open) if o["tag"] in tags), None)
        if re.fullmatch("h[1-6]", tag) and text:
            level = int(tag[1])
            self.path = self.path[: level - 1] + [text]
            self.out.append({"kind": "heading", "level": level, "text": text, "path": list(self.path)})
        elif tag == "title":
            self.out.append({"kind": "title", "text": text})
        elif tag == "a" and x["href"]:
            self.out.append({"kind": "link", "text": text, "url": urljoin(self.base, x["href"]), "path": list(self.path)})
        elif tag in ("td", "th") and (row := holder("tr")) is not None:
            row["items"].append((tag, text))
        elif tag == "tr" and x["items"] and (table := holder("table")) is not None:
            table["rows"].append(x["items"])
        elif tag == "table" and x["rows"]:
            heads = [r for r in x["rows"] if any(t == "th" for t, _ in r)][:1]
            rows = [[c for _, c in r] for r in heads + [r for r in x["rows"] if r not in heads]]
            width = max(map(len, rows))
            cells = [r + [""] * (width - len(r)) for r in rows]
            self.out.append({"kind": "table", "text": "\n".join(" | ".join(r) for r in cells), "cells": cells, "path": list(self.path)})
        elif tag == "li" and (top := holder("ul", "ol")) is not None and text:
            top["items"].append(text)
        elif tag in ("dt", "dd") and (top := holder("dl")) is not None:
            top["items"].append((tag, text))
        elif tag in ("ul", "ol") and x["items"]:
            marks = (f"{i + 1}." if tag == "ol" else "-" for i in range(len(x["items"])))
            self.out.append({"kind": "list", "text": "\n".join(f"{m} {t}" for m, t in zip(marks, x["items"])), "path": list(self.path)})
        elif tag == "dl" and x["items"]:
            lines = []
            for i, (t, term) in enumerate(x["items"]):
                if t == "dt":
                    follows = x["items"][i + 1][1] if i + 1 < len(x["items"]) and x["items"][i + 1][0] == "dd" else ""
                    lines.append(f"{term}: {follows}".strip())
            self.out.append({"kind": "list", "text": "\n".join(lines), "path": list(self.path)})


def parse_html(page: str, base: str = "") -> list[dict]:
    parser = _Page(base)
    parser.feed(page)
    parser.close()
    return parser.out


def html_blocks(pages: DataFrame, key: str = "page_id", page: str = "html", url: str = "url") -> DataFrame:
    """Title, headings with paths, links and images (resolved), padded tables and bulleted lists, in page order."""
    return _rows(pages, key, page, parse_html, url)


def html_version(page: Column) -> Column:
    low = F.lower(F.regexp_replace(page, r"^\s+", ""))
    return F.when(low.startswith("<!doctype html"), "HTML5").when(low.contains("<!doctype xhtml"), "XHTML")


def _joined(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([u if not b or u is None else urljoin(b, u) for u, b in zip(url, base)])


def resolved_url(url: Column, base: Column) -> Column:
    """A URL seen from a base; as it is where the base is null or empty."""
    return F.pandas_udf(_joined, "string")(url, base)


def contents(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, position, level, title, parent, line): headings in order; the parent is the position of the nearest one before with a lesser level.

    Headings without a title are left out, titles are cut at 500 characters.
    """
    heads = blocks.where("kind = 'heading' and text != ''")
    one = F.struct("place", "level", F.substring("text", 1, 500).alias("title"), F.col("line_start").alias("line"))
    rows = heads.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("h"))
    rows = rows.select(key, "h", F.posexplode("h").alias("position", "x"))
    before = F.filter(F.transform(F.slice("h", 1, F.col("position")), lambda y, i: F.when(y["level"] < F.col("x.level"), i)), lambda i: i.isNotNull())
    return rows.select(key, "position", "x.level", "x.title", F.array_max(before).alias("parent"), "x.line")


def paragraphs_with_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_start, line_end, content): stretches between blank lines, lines counted from 1."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "t"))
    lines = lines.withColumn("blank", F.trim(F.regexp_replace("t", r"\s+", " ")) == "")
    island = F.sum(F.col("blank").cast("int")).over(Window.partitionBy(key).orderBy("line"))
    rows = lines.withColumn("island", island).where(~F.col("blank"))
    right = F.regexp_replace("t", r"\s+$", "")
    out = rows.groupBy(key, "island").agg((F.min("line") + 1).alias("line_start"), (F.max("line") + 1).alias("line_end"), F.sort_array(F.collect_list(F.struct("line", right.alias("t")))).alias("ts"))
    return out.select(key, "line_start", "line_end", F.regexp_replace(F.array_join("ts.t", "\n"), r"^\s+|\s+$", "").alias("content"))
