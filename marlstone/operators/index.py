"""Indexes for repeated queries: postings for BM25, cells of vectors for exact nearest neighbours with pruning.

Both are written once as Parquet, dealt to folders by which a query prunes its scan, and give the results of
the scans in ``search``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import dot, grouped_terms, tokens
from marlstone.operators.search import top
from marlstone.plans.stash import Stash

#: Folders of postings; a query reads those of its words.
FOLDERS = 64


@dataclass
class TermIndex:
    """Postings (folder, token, key, tf, dl) at ``path``, and how many rows and words a row there are."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    rows: int
    mean: float

    def bm25(self, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, score) as ``search.bm25`` gives; words of one query are few, their postings are what is read."""
        terms = sorted({w.lower() for w in words})
        folders = sorted({zlib.crc32(w.encode()) % FOLDERS for w in terms})
        found = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("folder").isin(folders) & F.col("token").isin(terms))
        df = found.groupBy("token").agg(F.count("*").alias("df"))  # one row a word of the query
        idf = F.log(1 + (F.lit(float(self.rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(self.mean or 1.0)))
        return found.join(F.broadcast(df), "token").withColumn("s", one).groupBy(self.key).agg(F.sum("s").alias("score"))


def term_index(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> TermIndex:
    """Postings of every word of every row; counted within the row, dealt by word and sorted, so that a word's rows lie together.

    Keys are taken to be unique; postings are shuffled once.

    Without a path the index is in the shared folder until the driver ends.
    """
    path = path or f"{Stash(docs.sparkSession).root}/terms"
    words = docs.select(key, tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("dl"), F.explode(grouped_terms(F.col("w"))).alias("g"))
    rows = words.select("g.term", key, "dl", F.size("g.places").cast("long").alias("tf")).withColumnRenamed("term", "token")
    rows = rows.withColumn("folder", F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(FOLDERS)).cast("int"))
    # a frequent word's postings go to several files, as the key deals them, too
    rows.repartition("folder", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("token", key).write.mode("overwrite").partitionBy("folder").parquet(path)
    size = docs.agg(F.count("*").alias("n")).first().n
    schema = f"token string, {key} {dict(docs.dtypes)[key]}, dl int, tf long, folder int"
    total = docs.sparkSession.read.schema(schema).parquet(path).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n")).first().n
    return TermIndex(docs.sparkSession, path, schema, key, size, total / size if size else 0.0)


#: Vectors that centres are fitted on, at most; cells of an index; cells that are always looked at.
SAMPLE, CELLS, NEAREST = 20_000, 64, 2


@dataclass
class VectorIndex:
    """Vectors (cell, key, embedding) at ``path``, unit centres of cells and the widest angle of each."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    centres: np.ndarray
    widest: dict[int, float]

    def knn(self, query: list[float], k: int) -> DataFrame:
        """(key, score): exactly the k nearest by cosine. The nearest cells give a score that is reached; of the others only
        those are read in which, by the triangle inequality of angles, a better one may be."""
        q = np.asarray(query, float)
        norm = float(np.linalg.norm(q))
        if not norm or not self.widest:
            return self._scored(sorted(self.widest), [0.0] * len(query), 1.0, k)
        angles = np.arccos(np.clip(self.centres @ (q / norm), -1, 1))
        order = [int(c) for c in np.argsort(angles, kind="stable") if int(c) in self.widest]
        first = order[:NEAREST]
        got = self._scored(first, query, norm, k).collect()  # k rows
        least = got[-1].score if len(got) == k else -2.0
        rest = [c for c in order[NEAREST:] if math.cos(max(0.0, angles[c] - self.widest[c])) >= least - 1e-6]
        return self._scored(first + rest, query, norm, k)

    def _scored(self, cells: list[int], query, norm: float, k: int) -> DataFrame:
        v = F.col("embedding")
        length = F.sqrt(dot(v, v))
        score = F.when(length == 0, 0.0).otherwise(dot(v, F.array(*[F.lit(float(x)) for x in query])) / (length * norm))
        return top(self.spark.read.schema(self.schema).parquet(self.path).where(F.col("cell").isin(cells)).select(self.key, score.alias("score")), k, key=self.key)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centres by spherical k-means."""
    length = np.linalg.norm(sample, axis=1)
    x = sample[length > 0] / length[length > 0, None]
    if not len(x):
        return np.eye(1, sample.shape[1])
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def vector_index(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cells: int = CELLS, path: str | None = None) -> VectorIndex:
    """Centres from a bounded sample (the rows of the least hashes), every row in the cell of its nearest centre. Vectors of other sizes are left out."""
    spark = vectors.sparkSession
    path = path or f"{Stash(spark).root}/vectors"
    some = vectors.where(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(column).toPandas()[column]  # SAMPLE is the bound
    dims = len(some.iloc[0]) if len(some) else 1
    centres = fit_centres(np.array([x for x in some if len(x) == dims], float).reshape(-1, dims), cells)
    shared = spark.sparkContext.broadcast(centres)  # cells * dims numbers

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for frame in frames:
            frame = frame[[x is not None and len(x) == c.shape[1] for x in frame["embedding"]]]
            if not len(frame):
                continue
            x = np.stack(frame["embedding"].to_numpy()).astype(float)
            length = np.linalg.norm(x, axis=1)
            cos = (x @ c.T) / np.where(length > 0, length, 1)[:, None]
            at = np.argmax(cos, axis=1)
            yield frame.assign(cell=at.astype("int32"), angle=np.arccos(np.clip(cos[np.arange(len(at)), at], -1, 1)))

    kinds = dict(vectors.dtypes)
    schema = f"{key} {kinds[key]}, embedding {kinds[column]}, cell int, angle double"
    rows = vectors.select(key, F.col(column).alias("embedding")).mapInPandas(place, schema)
    # cells of many vectors go to several files
    rows.repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)
    widest = {int(r.cell): r.widest for r in spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.max("angle").alias("widest")).collect()}  # one row a cell
    return VectorIndex(spark, path, schema, key, centres, widest)
