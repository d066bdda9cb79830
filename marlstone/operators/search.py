"""Retrieval over chunk tables: predicates, BM25, vectors, fusion, facets."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import WORD, dot, tokens
from marlstone.operators.relational import numbered
from marlstone.plans.stash import Stash


def compile_filters(filters: dict | None) -> Column:
    """{field: value | {gte, gt, lte, lt} | {in: [...]}} as one conjunction; all fields count."""
    out = F.lit(True)
    for name, want in (filters or {}).items():
        c = F.col(name)
        if not isinstance(want, dict):
            out &= c == want
            continue
        for op, value in want.items():
            out &= {"gte": lambda v: c >= v, "gt": lambda v: c > v, "lte": lambda v: c <= v, "lt": lambda v: c < v, "in": lambda v: c.isin(list(v))}[op](value)
    return out


def phrase(text: Column, words: str) -> Column:
    """Whether the tokens of ``words`` stand next to each other in the text."""
    found = [w.lower() for w in re.findall(r"\w+", words)]
    # most texts lack the longest word; only the others are taken apart
    may = F.lower(text).contains(max(found, key=len)) if found else F.lit(True)
    return may & F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).contains(f" {' '.join(found)} ")


def boolean(text: Column, query: str) -> Column:
    """NOT binds tightest, then AND, then OR; parentheses group; bare words side by side are AND."""
    parts = re.findall(r"\(|\)|\"[^\"]*\"|[^\s()]+", query)
    at = 0

    def peek() -> str:
        return parts[at].upper() if at < len(parts) else ""

    def either() -> Column:
        nonlocal at
        out = both()
        while peek() == "OR":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = one()
        while peek() not in ("", "OR", ")"):
            at += peek() == "AND"
            out = out & one()
        return out

    def one() -> Column:
        nonlocal at
        if peek() == "NOT":
            at += 1
            return ~one()
        word, at = parts[at], at + 1
        if word == "(":
            out = either()
            at += 1
            return out
        return phrase(text, word.strip('"'))

    return either()


def wildcard(text: Column, pattern: str) -> Column:
    """Whether a token matches a pattern with * and ?."""
    rx = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern.lower())
    return F.exists(tokens(text), lambda t: t.rlike(f"^{rx}$"))


def occurrences(low: Column, term: str) -> Column:
    """How often a token stands in a lower-case text; the texts that lack its letters are not searched."""
    edge = r"[\p{L}\p{N}_]"
    return F.when(low.contains(term), F.regexp_count(low, F.lit(f"(?<!{edge}){re.escape(term)}(?!{edge})"))).otherwise(0)


def bm25(
    docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, score) and the kept columns of the documents with a query term.

    One scan: the query is a few terms, so a document's counts are a fixed set of columns and no
    postings are shuffled. The counts are written once; the corpus statistics, one row, and the
    scores come from there.
    """
    terms = sorted({w.lower() for w in query})
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(key, *keep, F.regexp_count(low, F.lit(WORD)).alias("dl"), *[occurrences(low, w).alias(f"tf{i}") for i, w in enumerate(terms)])
    rows = Stash(docs.sparkSession).put(rows)
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    if not stats.n or not terms:
        return rows.select(key, *keep, F.lit(0.0).alias("score")).where("false")
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = stats[f"df{i}"]
        idf = F.log(F.lit(1 + (stats.n - df + 0.5) / (df + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(float(stats.avgdl or 1))))
    hit = reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    return rows.where(hit).select(key, *keep, score.alias("score"))


def top(rows: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    return rows.orderBy(F.col(score).desc(), key).limit(k)


def knn(vectors: DataFrame, query: list[float] | None, k: int, key: str = "vec_id", column: str = "embedding", least: float | None = None, without: int | None = None) -> DataFrame:
    """(key, score) of the k nearest by cosine; the threshold is applied after the limit. Without a query vector there are none."""
    if query is None:
        return vectors.select(key, F.lit(0.0).alias("score")).where("false")
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    v = F.col(column)
    length = F.sqrt(dot(v, v))
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if without is None else vectors.where(F.col(key) != without)
    score = F.when((F.size(v) != len(query)) | (length == 0) | F.lit(norm == 0), 0.0).otherwise(dot(v, q) / (length * F.lit(norm or 1.0)))
    out = top(rows.select(key, score.alias("score")), k, key=key)
    return out if least is None else out.where(F.col("score") >= least)


def fuse(left: DataFrame, right: DataFrame, key: str, how: str = "linear", alpha: float = 0.5, most: int | None = 1000) -> DataFrame:
    """(key, score) of a full outer join: alpha * left + (1 - alpha) * right, raw, scaled to 0..1, or by ranks (rrf).

    Ranks are of the ``most`` best of either side, or of all with None: these are numbered by ranges of the scores.
    """
    wa, wb = alpha, 1 - alpha
    if how == "rrf":
        order = [F.col("score").desc(), F.col(key)]
        if most is None:
            ranked = [numbered(d.select(key, "score"), *order, name="_n").select(key, (1.0 / (60 + F.col("_n"))).alias("score")) for d in (left, right)]
        else:
            ranked = [top(d.select(key, "score"), most, key=key).select(key, (1.0 / (60 + F.row_number().over(Window.orderBy(*order)))).alias("score")) for d in (left, right)]
        left, right, wa, wb = *ranked, 1.0, 1.0
    elif how == "minmax":
        scaled = []
        for d in (left, right):
            ends = d.agg(F.min("score").alias("low"), F.max("score").alias("high"))  # one row
            rows = d.select(key, "score").join(F.broadcast(ends))
            scaled.append(rows.select(key, F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0).alias("score")))
        left, right = scaled
    a, b = left.withColumnRenamed("score", "a"), right.withColumnRenamed("score", "b")
    return a.join(b, key, "full_outer").select(key, (F.coalesce("a", F.lit(0.0)) * wa + F.coalesce("b", F.lit(0.0)) * wb).alias("score"))


def merge_max(vector: DataFrame, keyword: DataFrame, key: str) -> DataFrame:
    """.7 of the vector score and .3 of the keyword score where both are positive, else the one there is."""
    rows = vector.select(key, F.col("score").alias("v"), F.lit(0.0).alias("k")).unionByName(keyword.select(key, F.lit(0.0).alias("v"), F.col("score").alias("k")))
    rows = rows.groupBy(key).agg(F.max("v").alias("v"), F.max("k").alias("k"))
    return rows.select(key, F.when((F.col("v") > 0) & (F.col("k") > 0), 0.7 * F.col("v") + 0.3 * F.col("k")).otherwise(F.greatest("v", "k")).alias("score"))


def facets(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) over all fields in one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in fields]))
    return docs.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
