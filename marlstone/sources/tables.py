"""Tables of delimited files and sheets: header and column kinds, windows, Markdown, parts put together again."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.relational import row_windows

CELLS = "array<array<string>>"


def is_number(cell: Column) -> Column:
    """Digits with any full stops and hyphens."""
    return F.coalesce(F.regexp_replace(F.trim(cell), r"[.\-]", "").rlike(r"^\d+$"), F.lit(False))


def header_score(cells: Column) -> Column:
    """How much a row looks like a header: filled cells count 0.6, those that are no numbers 0.4."""
    n = F.size(cells)
    filled = F.size(F.filter(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    words = F.size(F.filter(cells, lambda c: (F.coalesce(c, F.lit("")) != "") & ~is_number(c)))
    return F.when((n > 0) & (filled > 0), 0.6 * filled / n + 0.4 * words / n).otherwise(0.0)


def header_rows(rows: DataFrame, group: str, row: str = "row", cells: str = "cells", most: int = 5) -> DataFrame:
    """(group, header): the best of the first rows (0-based) if it scores above 0.5, of equals the first; else null."""
    scored = rows.where(F.col(row) < most).withColumn("s", header_score(F.col(cells)))
    best = scored.groupBy(group).agg(F.max("s").alias("s"), F.max_by(row, F.struct("s", -F.col(row))).alias("at"))
    return best.select(group, F.when(F.col("s") > 0.5, F.col("at")).alias("header"))


def named_rows(rows: DataFrame, group: str, row: str = "row", cells: str = "cells") -> DataFrame:
    """(group, row, cells, names): rows below the header with its names; without a header columns are numbered. Blank rows go."""
    heads = header_rows(rows, group, row, cells)
    first = rows.join(heads.where("header is not null"), group).where(F.col(row) == F.col("header")).select(group, F.col("header").alias("_at"), F.col(cells).alias("_names"))
    out = rows.join(first, group, "left").where(F.col("_at").isNull() | (F.col(row) > F.col("_at")))
    out = out.where(F.exists(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    numbered = F.transform(cells, lambda c, i: F.concat(F.lit("column_"), (i + 1).cast("string")))
    names = F.transform(cells, lambda c, i: F.coalesce(F.nullif(F.get(F.col("_names"), i), F.lit("")), F.element_at(numbered, i + 1)))
    return out.select(group, row, cells, names.alias("names"))


def column_kinds(rows: DataFrame, group: str, row: str = "row", cells: str = "cells", sample: int = 100) -> DataFrame:
    """(group, column, numeric, datetime, filled): over the first rows more than half numbers, more than 0.3 ISO dates."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(row))).where(F.col("_n") <= sample)
    each = first.select(group, F.posexplode(cells).alias("column", "c"))
    date = F.col("c").rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("double"))
    out = each.groupBy(group, "column").agg(share(is_number(F.col("c"))).alias("n"), share(date).alias("d"), share(F.col("c") != "").alias("filled"))
    return out.select(group, "column", (F.col("n") > 0.5).alias("numeric"), (F.col("d") > 0.3).alias("datetime"), "filled")


def markdown_table(names: Column, rows: Column, cut: int = 100) -> Column:
    """Header, rule and rows of a Markdown table; rows are padded or cut to the header, cells to ``cut`` characters."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = lambda r: F.transform(names, lambda _, i: F.substring(F.coalesce(F.get(r, i), F.lit("")), 1, cut))
    rule = line(F.transform(names, lambda _: F.lit("---")))
    body = F.transform(rows, lambda r: line(padded(r)))
    return F.when(F.size(names) > 0, F.array_join(F.concat(F.array(line(names), rule), body), "\n")).otherwise("")


def kept_columns(kinds: DataFrame, group: str, wide: int = 20, densest: int = 10) -> DataFrame:
    """(group, kept): all columns, or of wide tables the densest and those with numbers."""
    order = Window.partitionBy(group).orderBy(F.desc("filled"), "column")
    n = F.count("*").over(Window.partitionBy(group))
    rows = kinds.withColumn("_k", F.row_number().over(order)).withColumn("_all", n)
    keep = rows.where((F.col("_all") <= wide) | (F.col("_k") <= densest) | F.col("numeric"))
    return keep.groupBy(group).agg(F.sort_array(F.collect_list("column")).alias("kept"))


def sheet_windows(rows: DataFrame, group: str, names: list[str], order: list[str], size: int = 50, overlap: int = 10) -> DataFrame:
    """(group, window_id, row_start, row_end, table) of sliding row windows; the table is Markdown of the named columns."""
    listed = rows.withColumn("row", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    cells = F.array(*[F.col(c).cast("string") for c in names])
    windows = row_windows(listed.select(group, "row", cells.alias("cells")), group, ["row"], size, overlap)
    out = windows.groupBy(group, "window_id").agg(F.min("row").alias("row_start"), F.max("row").alias("row_end"), F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("r"))
    return out.select(group, "window_id", "row_start", "row_end", markdown_table(F.array(*map(F.lit, names)), F.col("r.cells")).alias("table"))


def table_of_parts(parts: DataFrame, group: str, part: str = "part_index", headers: str = "headers", cells: str = "cells") -> DataFrame:
    """(group, headers, cells) of tables in parts: headers of the first part, cells (JSON) below each other, null cells empty."""
    rows = F.from_json(cells, CELLS)
    out = parts.groupBy(group).agg(F.min_by(headers, part).alias("headers"), F.sort_array(F.collect_list(F.struct(F.col(part).alias("p"), F.coalesce(rows, F.array().cast(CELLS)).alias("rows")))).alias("r"))
    whole = F.flatten(F.col("r.rows"))
    return out.select(group, "headers", F.transform(whole, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))).alias("cells"))


def part_offsets(parts: DataFrame, group: str, part: str = "part_index", rows: str = "n_rows") -> DataFrame:
    """Parts with ``offset``, the rows of those before."""
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(rows).over(before), F.lit(0)))


def part_slices(parts: DataFrame, whole: DataFrame, group: str) -> DataFrame:
    """Cells of a whole table dealt to its parts again, by their numbers of rows."""
    at = part_offsets(parts, group).select(group, "part_index", "offset", "n_rows").join(whole.select(group, "cells"), group)
    return at.select(group, "part_index", F.slice("cells", (F.col("offset") + 1).cast("int"), F.col("n_rows").cast("int")).alias("cells"))


def merged_tables(items: DataFrame, group: str, tolerance: float = 8.0) -> DataFrame:
    """Tables of a page (left, top, right, bottom, page_width, cells) put together where they continue each other.

    Of one column, at most 5 % of the page off, and no further below than four tolerances. A first row that
    repeats the row before goes.
    """
    order = Window.partitionBy(group).orderBy("top", "left")
    lag = lambda c: F.lag(c).over(order)
    near = F.greatest(F.col("page_width"), lag("page_width"), F.lit(1.0)) * 0.05
    gap = F.col("top") - lag("bottom")
    joins = (F.abs(F.col("left") - lag("left")) <= near) & (F.abs(F.col("right") - lag("right")) <= near) & (gap <= 4 * tolerance)
    rows = items.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    rows = rows.withColumn("_last", lag(F.element_at("cells", -1))).withColumn("table", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.when((F.col("_new") == 0) & F.element_at("cells", 1).eqNullSafe(F.col("_last")), F.slice("cells", 2, F.size("cells"))).otherwise(F.col("cells"))
    rows = rows.withColumn("_own", own)
    out = rows.groupBy(group, "table").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.sort_array(F.collect_list(F.struct("top", "_own"))).alias("r"))
    return out.select(group, "table", "left", "top", "right", "bottom", F.flatten("r._own").alias("cells"))


def merged_short_texts(items: DataFrame, group: str, longest: int = 60) -> DataFrame:
    """Text boxes (place, left, right, page_width, text) with short ones side by side joined by blanks.

    A box joins the run before it if both are short and no more than 5 % of the page apart. (group, run, text).
    """
    order = Window.partitionBy(group).orderBy("place")
    lag = lambda c: F.lag(c).over(order)
    short = F.length("text") <= longest
    joins = short & (F.length(lag("text")) <= longest) & (F.abs(lag("right") - F.col("left")) <= F.greatest("page_width", F.lit(1.0)) * 0.05)
    rows = items.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(group, "run").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("r"))
    return out.select(group, "run", F.trim(F.array_join("r.text", " ")).alias("text"))


def window_stats(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, low, high, mean, n) of numeric columns; zeros and nulls don't count.

    The mean divides an exact sum of decimals once, so it doesn't depend on the order of rows.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    each = rows.select(*keys, pairs.alias("p")).select(*keys, "p.*").where("v is not null and v != 0")
    return each.groupBy(*keys, "column").agg(F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(F.col("v").cast("decimal(28,8)")).cast("double") / F.count("*")).alias("mean"), F.count("*").alias("n"))


def _walk(value, path: str, depth: int):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(value)]
    yield path, kind, None if kind in ("object", "array") else str(value)
    if depth and isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, f"{path}.{k}", depth - 1)
    elif depth and isinstance(value, list) and value:
        yield from _walk(value[0], f"{path}[]", depth - 1)


def _walk_xml(node, path: str, depth: int):
    yield path, "element" if len(node) else "text", (node.text or "").strip() or None
    for k, v in node.attrib.items():
        yield f"{path}@{k}", "attribute", v
    seen = set()
    for x in node if depth else ():
        if x.tag not in seen:
            seen.add(x.tag)
            yield from _walk_xml(x, f"{path}/{x.tag}", depth - 1)


def previews(rows: DataFrame, key: str, kind: str, text: str, depth: int = 5) -> DataFrame:
    """(key, path, type, sample) of the structure of JSON, XML and CSV texts, by their kind; of lists the first element, of columns the first cell."""

    def look(what: str, content: str) -> list[tuple]:
        if what == "json":
            return list(_walk(json.loads(content), "$", depth))
        if what == "xml":
            root = ElementTree.fromstring(content)
            return list(_walk_xml(root, "/" + root.tag, depth))
        if what == "csv":
            lines = [r for _, r in zip(range(2), csv.reader(io.StringIO(content)))]
            return [(name, "column", lines[1][i] if len(lines) > 1 and i < len(lines[1]) else None) for i, name in enumerate(lines[0] if lines else [])]
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, what, content in zip(frame[key], frame[kind], frame[text]):
                try:
                    out += [(k, n, *x) for n, x in enumerate(look(what, content or ""))]
                except (ValueError, ElementTree.ParseError):
                    out.append((k, 0, "$", "invalid", None))
            yield pd.DataFrame(out, columns=[key, "place", "path", "type", "sample"])

    return rows.select(key, kind, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, place int, path string, type string, sample string")
