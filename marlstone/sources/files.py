"""Files in and out: texts in several encodings, delimited rows, chunk archives, page parts."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.classify import code_language, is_ignored, is_minified

# Encodings that are tried in this order; the last takes any bytes.
ENCODINGS = ("utf-8-sig", "gb18030", "latin-1")


def decode(content: bytes | None) -> str:
    """Text of the first encoding that fits, without a byte-order mark, line ends made uniform."""
    for name in ENCODINGS:
        try:
            return (content or b"").decode(name).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            pass
    raise AssertionError("latin-1 takes any bytes")


def _decoded(content: pd.Series) -> pd.Series:
    return content.map(decode)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of whole files of any depth, in the first encoding that fits."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.pandas_udf(_decoded, "string")("content").alias("text"))


def read_rows(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited file with all values as strings, quotes in quoted cells doubled; blank rows go."""
    rows = spark.read.csv(path, sep=sep, header=header, inferSchema=False, multiLine=False, escape='"')
    return rows.na.drop("all")


def read_cells(spark: SparkSession, path: str, sep: str = ",", most: int | None = None) -> DataFrame:
    """(path, row, cells) of delimited files whose header is not known; blank rows go, the others are numbered from 0.

    Cells with quotes may hold separators and line ends. ``most`` bounds the rows of a file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows = (r for r in csv.reader(io.StringIO(decode(content), newline=""), delimiter=sep) if any(c.strip() for c in r))
                out = []
                for n, cells in enumerate(rows):
                    if most is not None and n >= most:
                        break
                    out.append((name, n, cells))
                    if len(out) == 5000:
                        yield pd.DataFrame(out, columns=["path", "row", "cells"])
                        out = []
                yield pd.DataFrame(out, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, cells array<string>")


def write_chunks(chunks: DataFrame, path: str, *parts: str) -> None:
    """A chunk archive: gzip JSON lines, partitioned for pruning."""
    writer = chunks.write.mode("overwrite").option("compression", "gzip")
    (writer.partitionBy(*parts) if parts else writer).json(path)


def read_chunks(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def replace_chunk(chunks: DataFrame, index: int, text: str, column: str = "content", at: str = "chunk_index") -> DataFrame:
    return chunks.withColumn(column, F.when(F.col(at) == index, F.lit(text)).otherwise(F.col(column)))


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Delete by key: the rows whose keys aren't listed."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def merged(rows: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of ``news`` replace those of the same key."""
    return rows.join(news.select(key).distinct(), key, "left_anti").unionByName(news)


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def read_code(spark: SparkSession, path: str) -> DataFrame:
    """(path, language, content) of the code files below a folder, paths relative to it; ignored folders and minified files are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.split(":", 1)[-1].rstrip("/").lstrip("/")
    local = F.regexp_replace(F.col("path"), r"^[a-z][a-z0-9+.-]*:/*", "")
    short = F.when(local.startswith(root + "/"), F.substring(local, len(root) + 2, 2**30)).otherwise(local)
    rows = rows.select(short.alias("path"), "content").withColumn("language", code_language(F.col("path")))
    kept = rows.where(F.col("language").isNotNull() & ~is_ignored(F.col("path")) & ~is_minified(F.concat(F.lit("/"), "path")))
    return kept.select("path", "language", F.pandas_udf(_decoded, "string")("content").alias("content"))


OBJECT = "kind string, metadata struct<uid:string,name:string,namespace:string,resourceVersion:string>, spec string, status string"


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(uid, name, namespace, resource_version, kind, spec, status) of pages of a listing: JSON files with ``items``."""
    pages = spark.read.schema(f"items array<struct<{OBJECT.replace(' string', ':string').replace('metadata struct', 'metadata:struct')}>>").json(path, multiLine=True)
    return pages.select(F.explode("items").alias("o")).select("o.metadata.uid", "o.metadata.name", "o.metadata.namespace", F.col("o.metadata.resourceVersion").alias("resource_version"), "o.kind", "o.spec", "o.status")


def watched(lines: DataFrame, text: str = "value") -> DataFrame:
    """(type, uid, resource_version, object, relist) of watch events, one JSON object a line; the code 410 asks for a new listing."""
    e = F.from_json(text, "type string, object string")
    o = F.from_json(e["object"], "metadata struct<uid:string,resourceVersion:string>, code int")
    rows = lines.select(e.alias("e"), o.alias("o")).where("e.type is not null")
    return rows.select("e.type", "o.metadata.uid", F.col("o.metadata.resourceVersion").alias("resource_version"), "e.object", ((F.col("e.type") == "ERROR") & (F.col("o.code") == 410)).alias("relist"))


def watch_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Watch events of files that come into a folder, as a stream."""
    return watched(spark.readStream.text(folder))
