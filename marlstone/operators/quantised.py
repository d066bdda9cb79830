"""Approximate nearest neighbours for many queries: cells, product-quantised residuals, exact reranking.

Unit vectors are dealt to cells, whose number grows with the rows, by the nearest of centres that were fitted on a
bounded sample; what is left after the centre is kept as one byte for each of some parts of the vector. A query
is sent to its nearest cells, meets their codes there by joins on cell and piece, and the best of these are scored
exactly. Cells are cut into pieces of bounded size, so a cell that holds much of the table is many tasks. How many cells
are looked at is chosen on the sample for a recall that is asked for.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import cosine
from marlstone.operators.index import fit_centres
from marlstone.plans.stash import Stash

#: Vectors that centres and codes are fitted on, at most; sampled vectors for each cell at least.
SAMPLE, A_CELL = 50_000, 20
#: Bytes of a code, values of each, rows of a piece of a cell, and queries that are scored against it at a time.
PARTS, VALUES, PIECE, QUERIES = 16, 256, 50_000, 64
#: Queries of a cell in a slice, about.
SLICE = 20_000
#: Candidates for each neighbour that is asked for.
SPARE = 20


def _kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres by squared distance; fewer rows than centres are centres themselves."""
    if len(x) <= k:
        return np.concatenate([x, np.zeros((max(0, 1 - len(x)), x.shape[1]))])
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row, in blocks of bounded size."""
    half, out = (centres**2).sum(1) / 2, np.empty(len(x), np.int64)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = np.argmax(x[k : k + 4096] @ centres.T - half, axis=1)
    return out


def units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, 1))
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


@dataclass
class Codebook:
    """Centres of cells, and for each part of a vector the values that stand for it."""

    centres: np.ndarray
    values: list[np.ndarray]

    def cuts(self) -> list[int]:
        return np.linspace(0, self.centres.shape[1], len(self.values) + 1).astype(int).tolist()

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes of unit vectors."""
        cell = nearest(x, self.centres)
        rest, cuts = x - self.centres[cell], self.cuts()
        codes = [nearest(rest[:, a:b], v) for a, b, v in zip(cuts, cuts[1:], self.values)]
        return cell, np.stack(codes, 1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """About the cosines of unit queries with the coded vectors of one cell: queries by vectors."""
        out, cuts = np.repeat((q @ self.centres[cell])[:, None], len(codes), 1), self.cuts()
        for p, (a, b, v) in enumerate(zip(cuts, cuts[1:], self.values)):
            out += (q[:, a:b] @ v.T)[:, codes[:, p]]
        return out


def fit_codebook(sample: np.ndarray, rows: int) -> Codebook:
    """Cells go with the square root of the rows, as far as the sample can tell them apart."""
    cells = max(1, min(math.isqrt(max(rows, 1)), len(sample) // A_CELL))
    centres = fit_centres(sample, cells) if len(sample) else np.zeros((1, sample.shape[1]))
    book = Codebook(centres, [])
    rest = sample - centres[nearest(sample, centres)] if len(sample) else sample
    parts = min(PARTS, sample.shape[1])
    cuts = np.linspace(0, sample.shape[1], parts + 1).astype(int).tolist()
    book.values = [_kmeans(rest[:, a:b], VALUES) for a, b in zip(cuts, cuts[1:])]
    return book


def probes_for(book: Codebook, sample: np.ndarray, recall: float, k: int = 10, queries: int = 200) -> int:
    """The fewest cells in which that share of the ``k`` nearest sampled vectors of sampled queries lies."""
    if len(sample) <= k:
        return len(book.centres)
    cell, q = nearest(sample, book.centres), sample[:: max(1, len(sample) // queries)]
    score = q @ sample.T
    best = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, :k]
    order = np.argsort(-(q @ book.centres.T - (book.centres**2).sum(1) / 2), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)  # of a cell, by query
    needed = np.sort(np.take_along_axis(rank, cell[best], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


@dataclass
class QuantisedIndex:
    """Codes (cell, piece, key, code) and vectors (key, embedding) at ``path``."""

    spark: SparkSession
    path: str
    key: str
    kinds: dict[str, str]
    book: Codebook
    probes: int

    def codes(self) -> DataFrame:
        return self.spark.read.schema(f"cell int, piece int, {self.key} {self.kinds['key']}, code binary").parquet(f"{self.path}/codes")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"{self.key} {self.kinds['key']}, embedding {self.kinds['column']}").parquet(f"{self.path}/vectors")

    def knn(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query, key, score, rank) of about the ``k`` nearest by cosine of each query (query, embedding); scores are exact, ties by key.

        Queries whose vectors are null or of another size find nothing. Of vectors with one code ``k`` are looked at, those of
        the least keys: all that a result can hold if they are copies.
        """
        shared, wide = self.spark.sparkContext.broadcast(self.book), self.book.centres.shape[1]  # cells * dims and parts * VALUES numbers
        n, key, most = probes or self.probes, self.key, SPARE * k
        kind = dict(queries.dtypes)
        asked = queries.where(F.size("embedding") == wide).select("query", "embedding")

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres = shared.value.centres
            for frame in frames:
                score = units(frame["embedding"].tolist()) @ centres.T - (centres**2).sum(1) / 2
                cells = np.argsort(-score, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"query": np.repeat(frame["query"].to_numpy(), cells.shape[1]), "cell": cells.ravel().astype("int32"), "embedding": [v for v in frame["embedding"] for _ in range(cells.shape[1])]})

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query": [], key: [], "about": []})
            # of rows of one code, which score alike, no more than are asked for: copies don't crowd out others
            right = right.sort_values(key, kind="stable")
            right = right[right.groupby("code").cumcount() < k]
            codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
            names, asked_, out = right[key].to_numpy(), left["query"].to_numpy(), []
            x = units(left["embedding"].tolist())
            for at in range(0, len(left), QUERIES):
                score = shared.value.scores(x[at : at + QUERIES], int(left["cell"].iloc[0]), codes)
                some = np.argsort(-score, axis=1, kind="stable")[:, :most]
                out.append(pd.DataFrame({"query": np.repeat(asked_[at : at + QUERIES], some.shape[1]), key: names[some.ravel()], "about": np.take_along_axis(score, some, 1).ravel()}))
            return pd.concat(out, ignore_index=True)

        sent = asked.mapInPandas(near, f"query {kind['query']}, cell int, embedding {kind['embedding']}")
        pieces = self.codes().select("cell", "piece").distinct()
        # queries of a cell are dealt to slices of bounded size, each of which meets all its codes
        slices = max(1, math.ceil(asked.count() * n / len(self.book.centres) / SLICE))
        sent = sent.join(pieces, "cell").withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int"))
        codes = self.codes().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        group = ["cell", "piece", "slice"]
        found = sent.groupBy(*group).cogroup(codes.groupBy(*group)).applyInPandas(best, f"query {kind['query']}, {key} {self.kinds['key']}, about double")
        alike = Window.partitionBy("query", "about").orderBy(key)
        found = found.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k).drop("_r")
        order = Window.partitionBy("query").orderBy(F.desc("about"), key)
        found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("query", key)
        exact = found.join(self.vectors(), key).join(asked.withColumnRenamed("embedding", "_q"), "query")
        exact = exact.select("query", key, cosine(F.col("embedding"), F.col("_q")).alias("score"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), key)
        return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised_index(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", recall: float = 0.95, path: str | None = None) -> QuantisedIndex:
    """Centres and codes from a bounded sample (rows of the least hashes), every vector of the sample's size coded.

    Null vectors and those of other sizes are left out; keys are taken to be unique. Without a path the index is in the
    shared folder until the driver ends.
    """
    spark = vectors.sparkSession
    path = path or f"{Stash(spark).root}/quantised"
    held = vectors.where(F.col(column).isNotNull())
    rows = held.count()
    some = held.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(column).toPandas()[column]  # SAMPLE is the bound
    wide = len(some.iloc[0]) if len(some) else 1
    sample = units([v for v in some if len(v) == wide])
    book = fit_codebook(sample.reshape(-1, wide), rows)
    shared = spark.sparkContext.broadcast(book)
    kinds = dict(vectors.dtypes)
    pieces = max(1, -(-rows // PIECE))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cell, codes = shared.value.encode(units(frame["embedding"].tolist()))
                yield pd.DataFrame({"cell": cell.astype("int32"), key: frame[key], "code": [c.tobytes() for c in codes]})

    kept = held.where(F.size(column) == wide).select(key, F.col(column).alias("embedding"))
    kept.write.mode("overwrite").parquet(f"{path}/vectors")
    codes = kept.mapInPandas(encode, f"cell int, {key} {kinds[key]}, code binary")
    stash = Stash(spark)
    codes = stash.put(codes)
    # a cell has as many pieces as its rows ask for
    size = codes.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_n"))
    codes = codes.join(F.broadcast(size), "cell")  # one row a cell
    codes = codes.select("cell", F.pmod(F.xxhash64(key), F.col("_n")).cast("int").alias("piece"), key, "code")
    codes.repartitionByRange(max(1, min(pieces, 10_000)), "cell", "piece").sortWithinPartitions("cell", "piece").write.mode("overwrite").parquet(f"{path}/codes")
    stash.drop(codes)
    return QuantisedIndex(spark, path, key, {"key": kinds[key], "column": kinds[column]}, book, probes_for(book, sample, recall))


def describe(index: QuantisedIndex) -> str:
    """What an index is made of, and the bytes of codes that a query reads on average."""
    cells, parts = len(index.book.centres), len(index.book.values)
    rows = index.codes().count()
    return json.dumps({"rows": rows, "cells": cells, "bytes_a_code": parts, "probes": index.probes, "bytes_a_query": round(rows * parts * index.probes / cells)})
