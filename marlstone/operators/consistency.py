"""Agreement of stored rows with what was derived from them, and its repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(truth: DataFrame, index: DataFrame, key: str, *compared: str) -> DataFrame:
    """(key, problem) where the index and its source of truth disagree: missing, stale or orphan.

    One shuffled join on the key. Two nulls agree; rows with a null key are not looked at.
    """
    left = truth.where(F.col(key).isNotNull()).select(key, F.struct(F.lit(1), *compared).alias("_t"))
    right = index.where(F.col(key).isNotNull()).select(key, F.struct(F.lit(1), *compared).alias("_i"))
    problem = (
        F.when(F.col("_i").isNull(), "missing")
        .when(F.col("_t").isNull(), "orphan")
        .when(~F.col("_t").eqNullSafe(F.col("_i")), "stale")
    )
    return left.join(right, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def repaired(truth: DataFrame, index: DataFrame, key: str, *compared: str) -> DataFrame:
    """The index with missing and stale rows taken from the truth and orphans gone."""
    bad = differences(truth, index, key, *compared)
    kept = index.select(key, *compared).join(bad.select(key), key, "left_anti")
    return kept.unionByName(truth.select(key, *compared).join(bad.where("problem != 'orphan'").select(key), key, "left_semi"))


def repointed(edges: DataFrame, merges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges after entities were merged: ``merges`` has (merged, survivor); loops and repeats go."""
    for end in (src, dst):
        to = merges.select(F.col("merged").alias(end), F.col("survivor").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.where(F.col(src) != F.col(dst)).distinct()


def vector_sizes(truth: DataFrame, index: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, stored, indexed) where a vector's number of dimensions differs or one side has none."""
    a = truth.select(key, F.size(vector).alias("stored"))
    b = index.select(key, F.size(vector).alias("indexed"))
    return a.join(b, key, "full").where(~F.col("stored").eqNullSafe(F.col("indexed")))


def document_checks(chunks: DataFrame, index: DataFrame, vectors: DataFrame, versions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, indexed, vectors, versions, consistent) of each document of chunks (key, chunk, version, dims).

    Checked are that every chunk is in the index, that its vector has the right dimensions, and that its
    version is the latest.
    """
    last = versions.groupBy("chunk").agg(F.max("version").alias("_last"))
    rows = chunks.join(index.select("chunk", F.lit(True).alias("_in")).distinct(), "chunk", "left")
    rows = rows.join(vectors.select("chunk", F.size("vector").alias("_size")), "chunk", "left").join(last, "chunk", "left")
    ok = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    out = rows.groupBy(key).agg(ok(F.col("_in")).alias("indexed"), ok(F.col("_size") == F.col("dims")).alias("vectors"), ok(F.coalesce(F.col("_last"), F.col("version")) == F.col("version")).alias("versions"))
    return out.withColumn("consistent", F.col("indexed") & F.col("vectors") & F.col("versions"))
