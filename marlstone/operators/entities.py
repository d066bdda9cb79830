"""Entities and relations of texts: patterns, merging by aliases, relations across chunks, answers of models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import entity_name, stripped
from marlstone.operators.components import connected_components

# Patterns of entities, by language ("" for any).
PATTERNS = (
    ("en", "persons", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
    ("en", "persons", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+\b"),
    ("en", "locations", r"\b[A-Z][a-z]+ (?:City|Town|State|Country|Province)\b"),
    ("en", "locations", r"\b(?:New York|Los Angeles|Chicago|Houston|Phoenix|Philadelphia|San Antonio|San Diego|Dallas|San Jose)\b"),
    ("zh", "persons", r"[\x{4e00}-\x{9fff}]{2,4}(?:先生|女士|老师|教授|博士|主任|经理|总监)"),
    (
        "zh", "persons",
        "(?:王|李|张|刘|陈|杨|赵|黄|周|吴|徐|孙|胡|朱|高|林|何|郭|马|罗|梁|宋|郑|谢|韩|唐|冯|于|董|萧|程|曹|袁|邓|许|傅|沈|曾|彭|吕|苏|卢|蒋|蔡|贾|丁|魏|薛|叶|阎|余|潘|杜|戴|夏|钟|汪|田|任|姜|范|方|石|姚|谭|廖|邹|熊|金|陆|郝|孔|白|崔|康|"
        "毛|邱|秦|江|史|顾|侯|邵|孟|龙|万|段|漕|钱|汤|尹|黎|易|常|武|乔|贺|赖|龚|文)",
    ),
    ("zh", "locations", r"[\x{4e00}-\x{9fff}]{2,4}(?:市|县|区|省|州|国|城|镇|村|路|街|巷)"),
    (
        "zh", "locations",
        "(?:北京|上海|广州|深圳|杭州|南京|武汉|成都|西安|重庆|天津|青岛|大连|宁波|厦门|苏州|无锡|长沙|郑州|济南|福州|合肥|石家庄|太原|沈阳|长春|哈尔滨|呼和浩特|乌鲁木齐|银川|西宁|兰州|拉萨|昆明|贵阳|南宁|海口|三亚)",
    ),
    ("zh", "organizations", r"[\x{4e00}-\x{9fff}]{2,8}(?:公司|集团|企业|银行|医院|学校|大学|学院|研究所|中心|局|部|委|办|处|科)"),
    ("", "dates", r"\d{4}年\d{1,2}月\d{1,2}日"),
    ("", "dates", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("", "dates", r"\d{4}-\d{1,2}-\d{1,2}"),
    ("", "numbers", r"\d+\.?\d*"),
    ("", "numbers", r"\d{1,3}(?:,\d{3})*"),
)
# Capitalised names and places, with their confidences.
CAPITALISED = (("PERSON", r"[A-Z][a-z]+ [A-Z][a-z]+", 0.8), ("PLACE", r"[A-Z][a-z]+(?: [A-Z][a-z]+)*", 0.7))


def entities(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, kind, entity): what the patterns of a language find, each once."""
    one = lambda kind: lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("entity"))
    found = [
        F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), one(kind))
        for language, kind, p in PATTERNS
        if language in ("", lang)
    ]
    return docs.select(key, F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("e")).select(key, "e.*")


def capitalised(text: Column) -> Column:
    """Structs of type, value and confidence in order of kinds, then place."""
    one = lambda kind, sure: lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(sure).alias("confidence"))
    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), one(kind, sure)) for kind, p, sure in CAPITALISED]))


def merge_aliases(found: DataFrame, default: float = 0.5) -> DataFrame:
    """Entities (id, name, type, aliases, description, confidence) merged where a name or alias agrees, in any case.

    Order does not matter: entities that share a label, directly or over others, are one. It keeps
    name and type of the least id, all labels, the longest description and the highest
    confidence.
    """
    rows = found.withColumn("name", entity_name(F.col("name")))
    labels = F.array_union(F.array(F.lower("name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))
    spoken = rows.select("id", F.explode(labels).alias("label"))
    same = spoken.join(spoken.groupBy("label").agg(F.min("id").alias("first")), "label").where("id != first").select("id", "first")
    joined = connected_components(same, "id", "first").withColumnRenamed("node", "id")
    rows = rows.join(joined, "id", "left").withColumn("root", F.coalesce("component", "id"))
    out = rows.groupBy("root").agg(
        F.min_by(F.struct("name", "type"), "id").alias("kept"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))))).alias("labels"),
        F.max_by("description", F.struct(F.coalesce(F.length("description"), F.lit(0)), -F.col("id"))).alias("description"),
        F.max(F.coalesce("confidence", F.lit(default))).alias("confidence"),
    )
    aliases = F.filter("labels", lambda x: x != F.col("kept.name"))
    return out.select(F.col("root").alias("id"), "kept.name", "kept.type", aliases.alias("aliases"), "description", "confidence")


def first_relations(relations: DataFrame, order: str) -> DataFrame:
    """One row of each (source, target, type): the first."""
    w = Window.partitionBy("source", "target", "type").orderBy(order)
    return relations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cross_chunk_relations(mentions: DataFrame, known: DataFrame, confidence: float = 0.3) -> DataFrame:
    """(source, target, type, confidence): pairs of entities of two chunks or more each that share a chunk and aren't related yet.

    ``mentions`` has (name, chunk), ``known`` (source, target). Pairs are unordered, the lesser name first.
    """
    seen = mentions.where("name is not null").select("name", "chunk").distinct()
    often = seen.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    seen = seen.join(often, "name", "left_semi")
    other = seen.select(F.col("name").alias("target"), "chunk")
    pairs = seen.withColumnRenamed("name", "source").join(other, "chunk").where("source < target").select("source", "target").distinct()
    both = known.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    return pairs.join(both, ["source", "target"], "left_anti").select("*", F.lit("related_to").alias("type"), F.lit(confidence).alias("confidence"))


def _balanced(text: str | None) -> str | None:
    start = (text or "").find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return text[start : i + 1]
    return None


def _each_balanced(text: pd.Series) -> pd.Series:
    return text.map(_balanced)


def balanced_json(text: Column) -> Column:
    """The first object with balanced braces outside of strings; null without one."""
    return F.pandas_udf(_each_balanced, "string")(text)


def parse_answer(text: Column) -> Column:
    """A struct of keywords and summary from a model's answer: JSON, JSON within text, or labelled lines; null without either."""
    schema = "keywords array<string>, summary string"
    whole = F.from_json(F.when(stripped(text).startswith("{"), text), schema)
    inner = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{[^{}]*\})", 1), F.lit("")), schema)
    words, summary = F.regexp_extract(text, r"关键词[：:]\s*([^\n]+)", 1), stripped(F.regexp_extract(text, r"摘要[：:]\s*([^\n]+)", 1))
    listed = F.slice(F.filter(F.transform(F.split(words, "、"), stripped), lambda k: k != ""), 1, 5)
    lines = F.when((words != "") | (summary != ""), F.struct(listed.alias("keywords"), summary.alias("summary")))
    full = lambda x: F.when(x["keywords"].isNotNull() | x["summary"].isNotNull(), x)
    return F.coalesce(full(whole), full(inner), lines)
