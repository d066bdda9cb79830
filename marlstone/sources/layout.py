"""Elements of PDF pages from placed words, ruling lines and images, in windows over pages.

Ruling lines that cross make the grid of a table; words in a grid are its cells. Other words stand in
lines, lines are cut at wide gaps, and pieces that lie above each other make a column. A piece that is as wide
as the page parts the columns above it from those below. Lines of a column that are close are a paragraph.
What repeats at the edges of pages, decoration and contents go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import is_contents, is_decorative
from marlstone.plans.stash import Stash
from marlstone.sources.tables import merged_tables

#: Points by which words of a line and ends of lines may differ, and the gap between paragraphs.
LINE, SNAP, PARAGRAPH = 3.0, 3.0, 10.0
#: A gap of so many times the size of the word parts a line; a piece of this share of the page is wide.
GAP, WIDE = 1.6, 0.55
#: Share of the page's height in which headers and footers stand, their longest text, and a title's size.
EDGE, LONGEST_EDGE, TITLE = 0.08, 80, 1.2
PAGE = ["path", "page"]


def _islands(start: Column, end: Column, order, slack: float) -> Column:
    """1 where a row begins beyond the ends of all rows before it."""
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(start > before + slack, F.lit(True)).cast("int")


def _running(flag: str, order) -> Column:
    return F.sum(flag).over(order.rowsBetween(Window.unboundedPreceding, 0))


def page_tables(items: DataFrame) -> DataFrame:
    """(path, page, table, xs, ys): the edges of columns and rows of each grid of ruling lines.

    Lines that meet, from top to bottom and then from left to right, make one grid; it needs two upright
    and two lying ones.
    """
    rules = items.where("kind = 'rule'").withColumn("upright", (F.col("x1") - F.col("x0")) <= (F.col("bottom") - F.col("top")))
    # grids: islands of ruling lines from top to bottom, then from left to right in each
    down = Window.partitionBy(*PAGE).orderBy("top", "bottom", "x0", "place")
    rules = rules.withColumn("_new", _islands(F.col("top"), F.col("bottom"), down, SNAP)).withColumn("band", _running("_new", down))
    across = Window.partitionBy(*PAGE, "band").orderBy("x0", "x1", "top", "place")
    rules = rules.withColumn("_new", _islands(F.col("x0"), F.col("x1"), across, SNAP)).withColumn("side", _running("_new", across))
    grid = [*PAGE, "band", "side"]

    def edges(which: Column, place: Column, name: str) -> DataFrame:
        rows = rules.where(which).select(*grid, place.alias("at"))
        order = Window.partitionBy(*grid).orderBy("at")
        far = F.coalesce(F.col("at") - F.lag("at").over(order) > SNAP, F.lit(True))
        rows = rows.withColumn("_new", far.cast("int")).withColumn("_k", _running("_new", order))
        return rows.groupBy(*grid, "_k").agg(F.avg("at").alias("at")).groupBy(*grid).agg(F.sort_array(F.collect_list("at")).alias(name))

    columns = edges(F.col("upright"), (F.col("x0") + F.col("x1")) / 2, "xs")
    rows = edges(~F.col("upright"), (F.col("top") + F.col("bottom")) / 2, "ys")
    tables = columns.join(rows, grid).where("size(xs) >= 2 and size(ys) >= 2")
    return tables.select(*PAGE, F.struct("band", "side").alias("table"), "xs", "ys")


def _between(edges: str, at: Column) -> Column:
    """How many of the edges lie before a place."""
    return F.size(F.filter(edges, lambda e: e < at))


def table_cells(items: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables with ``cells``: words by the cell that their middle lies in, in reading order; empty cells are empty."""
    words = items.where("kind = 'word'").withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("top") + F.col("bottom")) / 2})
    inside = words.join(tables, PAGE).where("cx > element_at(xs, 1) and cx < element_at(xs, -1) and cy > element_at(ys, 1) and cy < element_at(ys, -1)")
    inside = inside.withColumns({"row": _between("ys", F.col("cy")), "column": _between("xs", F.col("cx"))})
    inside = inside.select(*PAGE, "table", "row", "column", F.round(F.col("top") / LINE).alias("line"), "x0", "place", "text")
    filled = inside.groupBy(*PAGE, "table", "row", "column").agg(F.sort_array(F.collect_list(F.struct("line", "x0", "place", "text"))).alias("w"))
    by_cell = filled.groupBy(*PAGE, "table").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "column"), F.array_join("w.text", " ")))).alias("texts"))
    rows = F.sequence(F.lit(1), F.size("ys") - 1)
    cell = lambda r, c: F.coalesce(F.try_element_at(F.col("texts"), F.struct(r.alias("row"), c.alias("column"))), F.lit(""))
    cells = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), F.size("xs") - 1), lambda c: cell(r, c)))
    return tables.join(by_cell, [*PAGE, "table"]).select(
        *PAGE, "table", F.element_at("xs", 1).alias("left"), F.element_at("ys", 1).alias("top"), F.element_at("xs", -1).alias("right"), F.element_at("ys", -1).alias("bottom"), cells.alias("cells")
    )


def text_pieces(words: DataFrame) -> DataFrame:
    """Words in lines, cut at wide gaps: (path, page, line, piece, x0, top, x1, bottom, size, text and the page's size)."""
    down = Window.partitionBy(*PAGE).orderBy("top", "x0", "place")
    rows = words.withColumn("_new", F.coalesce(F.col("top") - F.lag("top").over(down) > LINE, F.lit(True)).cast("int")).withColumn("line", _running("_new", down))
    across = Window.partitionBy(*PAGE, "line").orderBy("x0", "place")
    gap = F.col("x0") - F.lag("x1").over(across)
    rows = rows.withColumn("_new", F.coalesce(gap > GAP * F.greatest("size", F.lag("size").over(across)), F.lit(True)).cast("int")).withColumn("piece", _running("_new", across))
    out = rows.groupBy(*PAGE, "page_width", "page_height", "line", "piece").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.max("size").alias("size"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "place", "text"))), lambda w: w["text"]), " ").alias("text"),
    )
    return out


def paragraphs(pieces: DataFrame) -> DataFrame:
    """Pieces of lines in columns, and of a column those with small gaps together: (path, page, band, column, paragraph, box, size, text)."""
    wide = F.col("x1") - F.col("x0") >= WIDE * F.col("page_width")
    down = Window.partitionBy(*PAGE).orderBy("top", "x0")
    rows = pieces.withColumn("wide", wide)
    # a run of wide lines, or of others between them, is a band
    rows = rows.withColumn("_new", F.coalesce(F.col("wide") != F.lag("wide").over(down), F.lit(True)).cast("int")).withColumn("band", _running("_new", down))
    across = Window.partitionBy(*PAGE, "band").orderBy("x0", "x1", "top")
    rows = rows.withColumn("_new", _islands(F.col("x0"), F.col("x1"), across, 0.0)).withColumn("column", F.when(F.col("wide"), 1).otherwise(_running("_new", across)))
    own = Window.partitionBy(*PAGE, "band", "column").orderBy("top", "x0")
    apart = F.col("top") - F.lag("bottom").over(own) > PARAGRAPH
    other = F.abs(F.col("size") - F.lag("size").over(own)) > 0.15 * F.col("size")
    rows = rows.withColumn("_new", F.coalesce(apart | other, F.lit(True)).cast("int")).withColumn("paragraph", _running("_new", own))
    return rows.groupBy(*PAGE, "page_width", "page_height", "band", "column", "paragraph").agg(
        F.min("x0").alias("left"), F.min("top").alias("top"), F.max("x1").alias("right"), F.max("bottom").alias("bottom"), F.max("size").alias("size"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("top", "x0", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def _noise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"\d+", ""), r"\s+", " ")))


def without_edges(texts: DataFrame) -> DataFrame:
    """Texts less those at the top or bottom of pages that stand, but for numbers, on two pages of the file or more."""
    head = F.col("top") / F.col("page_height") < EDGE
    foot = (F.col("page_height") - F.col("bottom")) / F.col("page_height") < EDGE
    rows = texts.withColumns({"noise": _noise(F.col("text")), "edge": F.when(head, "head").when(foot, "foot")})
    again = rows.where("edge is not null and noise != ''").groupBy("path", "edge", "noise").agg(F.count_distinct("page").alias("n")).where("n >= 2")
    seen = again.select("path", "noise").distinct().withColumn("repeated", F.lit(True))
    out = rows.join(seen, ["path", "noise"], "left")
    return out.where(~(F.coalesce("repeated", F.lit(False)) & (F.length("noise") <= LONGEST_EDGE))).drop("noise", "edge", "repeated")


def pdf_elements(items: DataFrame) -> DataFrame:
    """(path, place, page, kind, left, top, right, bottom, text, cells) of what ``pdf_items`` gives.

    Kinds are Title, NarrativeText, Table, Image and error; places are of the file, in reading order: by page, then
    bands from top to bottom, then columns. Boxes are shares of the page. Files without elements give no rows.
    """
    items = Stash(items.sparkSession).put(items)  # else the files are read again for each kind of item
    sizes = items.where("kind != 'error'").groupBy(*PAGE).agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"), F.avg(F.when(F.col("kind") == "word", F.col("size"))).alias("usual"))
    tables = page_tables(items)
    cells = table_cells(items, tables).join(sizes.drop("usual"), PAGE)
    real = cells.where("size(cells) >= 2 and size(cells[0]) >= 2")
    merged = merged_tables(real.withColumn("on", F.struct("path", "page", F.col("page_width").alias("w"), F.col("page_height").alias("h"))), "on")
    merged = merged.select("on.path", "on.page", F.col("on.w").alias("page_width"), F.col("on.h").alias("page_height"), "left", "top", "right", "bottom", "cells")
    words = items.where("kind = 'word'")
    box = real.select(*PAGE, F.col("left").alias("tl"), F.col("top").alias("tt"), F.col("right").alias("tr"), F.col("bottom").alias("tb"))
    on = [words[c] == box[c] for c in PAGE]
    middle = "(x0 + x1) / 2 between tl and tr and (top + bottom) / 2 between tt and tb"
    words = words.join(box, [*on, F.expr(middle)], "left_anti")
    texts = without_edges(paragraphs(text_pieces(words)))
    texts = texts.where(~is_decorative(F.col("text")) & ~is_contents(F.col("text"))).join(sizes.select(*PAGE, "usual"), PAGE)
    none = F.lit(None).cast("array<array<string>>")
    title = F.when(F.col("size") >= TITLE * F.col("usual"), "Title").otherwise("NarrativeText")
    texts = texts.select(*PAGE, title.alias("kind"), "left", "top", "right", "bottom", "page_width", "page_height", "text", none.alias("cells"), "band", "column")
    as_text = F.array_join(F.transform("cells", lambda r: F.array_join(r, "\t")), "\n")
    other = lambda kind, rows, text, cells: rows.select(*PAGE, F.lit(kind).alias("kind"), "left", "top", "right", "bottom", "page_width", "page_height", text.alias("text"), cells.alias("cells"), F.lit(None).cast("long").alias("band"), F.lit(1).cast("long").alias("column"))
    found = texts.unionByName(other("Table", merged.where(~is_contents(as_text)), as_text, F.col("cells")))
    images = items.where("kind = 'image'").withColumnsRenamed({"x0": "left", "x1": "right"})
    found = found.unionByName(other("Image", images, F.col("text"), none))
    # a table or image stands in the band of the text above it, after what is above it
    down = Window.partitionBy(*PAGE).orderBy("top", "left").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("band", F.coalesce("band", F.max("band").over(down), F.lit(0)))
    order = Window.partitionBy("path").orderBy("page", "band", "column", "top", "left", "kind")
    share = lambda c, of: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col(of))).alias(c)
    found = found.withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    found = found.select("path", "place", "page", "kind", share("left", "page_width"), share("top", "page_height"), share("right", "page_width"), share("bottom", "page_height"), "text", "cells")
    errors = items.where("kind = 'error'").select("path", F.lit(None).cast("int").alias("place"), "page", "kind", *[F.lit(None).cast("double").alias(c) for c in ("left", "top", "right", "bottom")], F.col("error").alias("text"), none.alias("cells"))
    return found.unionByName(errors)
