"""Differences of two texts: lines, likeness, risk. Alignment is sequential, so it runs in Arrow batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COUNTS = "added int, removed int, hunks int, total int, change_ratio double"
_LINES = "array<struct<type:string,old_line:int,new_line:int,content:string>>"


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def _lines(text: str | None) -> list[str]:
    return (text or "").splitlines(keepends=True)


def similarity(a: Column, b: Column) -> Column:
    """Share of characters in matching blocks, 2 m / (|a| + |b|); two empty texts have 1, null counts as empty."""
    return F.pandas_udf(_ratios, "double")(a, b)


def _line_counts(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    out = []
    for x, y in zip(old, new):
        a, b = _lines(x), _lines(y)
        groups = list(difflib.SequenceMatcher(None, a, b).get_grouped_opcodes(3))
        added = sum(j2 - j1 for g in groups for tag, _, _, j1, j2 in g if tag != "equal")
        removed = sum(i2 - i1 for g in groups for tag, i1, i2, _, _ in g if tag != "equal")
        out.append((added, removed, len(groups), added + removed, (added + removed) / len(a) if a else 0.0))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _COUNTS.split(", ")])


def line_counts(old: Column, new: Column) -> Column:
    """Lines added and removed, hunks with three lines of context, and changes as a share of the old lines."""
    return F.pandas_udf(_line_counts, _COUNTS)(old, new)


def _line_rows(old: pd.Series, new: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(old, new):
        a, b = _lines(x), _lines(y)
        rows = []
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
            if tag == "equal":
                rows += [("equal", i + 1, j1 + i - i1 + 1, a[i].rstrip("\r\n")) for i in range(i1, i2)]
            else:
                rows += [("delete", i + 1, None, a[i].rstrip("\r\n")) for i in range(i1, i2)]
                rows += [("insert", None, j + 1, b[j].rstrip("\r\n")) for j in range(j1, j2)]
        out.append([dict(zip(("type", "old_line", "new_line", "content"), r)) for r in rows])
    return pd.Series(out)


def line_diff(rows: DataFrame, old: str, new: str, *keys: str) -> DataFrame:
    """(keys, place, type, old_line, new_line, content) of every line: equal, delete or insert, deletions first."""
    found = rows.select(*keys, F.posexplode(F.pandas_udf(_line_rows, _LINES)(F.col(old), F.col(new))).alias("place", "line"))
    return found.select(*keys, "place", "line.*")


def modified_lines(diff: DataFrame, *keys: str) -> DataFrame:
    """(keys, modified): deletions with an insertion right after them, of the lines of ``line_diff``."""
    after = F.lead("type").over(Window.partitionBy(*keys).orderBy("place"))
    pair = ((F.col("type") == "delete") & (F.col("_after") == "insert")).cast("int")
    return diff.withColumn("_after", after).groupBy(*keys).agg(F.sum(pair).alias("modified"))


def risk(counts: Column) -> Column:
    """high from half of the lines or 1000 changes, medium above 100 removed or 50 changed, else low."""
    return (
        F.when((counts["change_ratio"] >= 0.5) | (counts["total"] >= 1000), "high")
        .when((counts["removed"] > 100) | (counts["total"] > 50), "medium").otherwise("low")
    )


def processing_time(length: Column, likeness: Column) -> Column:
    """10 s, a second for 1000 characters and up to 30 s for what is unlike; in whole seconds, minutes or hours."""
    s = 10 + length / 1000.0 + (1 - likeness) * 30
    whole = lambda x, unit: F.concat(F.floor(x).cast("long").cast("string"), F.lit(unit))
    return F.when(s < 60, whole(s, "s")).when(s < 3600, whole(s / 60, "m")).otherwise(whole(s / 3600, "h"))
