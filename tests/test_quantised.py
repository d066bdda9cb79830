"""Quantised vectors: recall against brute force, exact scores, pieces and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import quantised
from marlstone.session import read_table


def brute(rows, queries, k):
    names = np.array([i for i, _ in rows])
    x = quantised.units([v for _, v in rows])
    out = {}
    for i, v in queries:
        score = x @ quantised.units([v])[0]
        best = np.lexsort((names, -np.round(score, 9)))[:k]
        out[i] = [(int(names[b]), float(score[b])) for b in best]
    return out


def test_recall_of_all_queries(spark):
    vectors = read_table(spark, "/root/testdata/sf0.1", "embeddings")
    made = quantised.quantised_index(vectors)
    rows = [(x.vec_id, x.embedding) for x in vectors.collect()]
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    queries = [(x.query, x.embedding) for x in asked.collect()]
    want, got = brute(rows, queries, 10), {}
    for x in made.knn(asked, 10).collect():
        got.setdefault(x.query, []).append((x.vec_id, x.score, x["rank"]))
    score = dict(rows)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _, _ in got[q]}) for q, _ in queries)
    assert hits / (10 * len(queries)) >= 0.9
    for q, found in got.items():
        assert len(found) == 10 and sorted(r for _, _, r in found) == list(range(1, 11))
        for i, s, _ in found:
            assert abs(s - float(quantised.units([score[i]])[0] @ quantised.units([score[q]])[0])) < 1e-6
        assert found and min(found, key=lambda x: x[2])[0] == q


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=16)).tolist()) for i in range(4000)]
    return rows + [(10_000 + i, centres[0].tolist()) for i in range(1500)]  # a third in one place


def test_clusters_need_few_cells_and_pieces_are_bounded(spark, clustered, monkeypatch):
    monkeypatch.setattr(quantised, "PIECE", 300)
    monkeypatch.setattr(quantised, "SLICE", 20)
    odd = [(20_000, None), (20_001, [1.0, 2.0]), (20_002, [0.0] * 16)]
    vectors = spark.createDataFrame(clustered + odd, "vec_id long, embedding array<double>")
    made = quantised.quantised_index(vectors)
    assert 1 < made.probes < len(made.book.centres) / 4
    sizes = made.codes().groupBy("cell", "piece").count().toPandas()["count"]
    assert sizes.max() < 500 and sizes.sum() == len(clustered) + 1
    asked = spark.createDataFrame([(i, v) for i, v in clustered[:4000:81]] + [(-1, None), (-2, [1.0])], "query long, embedding array<double>")
    want = brute(clustered, clustered[:4000:81], 5)
    got = {}
    for x in made.knn(asked, 5).collect():
        got.setdefault(x.query, []).append(x)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {x.vec_id for x in got[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    reopened = made.knn(asked.limit(0), 3)
    assert reopened.count() == 0


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    made = quantised.quantised_index(none)
    assert made.knn(none.withColumnRenamed("vec_id", "query"), 3).count() == 0


def test_codes_stand_for_vectors():
    rng = np.random.default_rng(1)
    x = quantised.units(rng.normal(size=(3000, 32)))
    book = quantised.fit_codebook(x, 3000)
    cell, codes = book.encode(x)
    cuts = book.cuts()
    back = book.centres[cell] + np.concatenate([v[codes[:, p]] for p, v in enumerate(book.values)], 1)
    assert cuts[-1] == 32 and np.abs(((x - back) ** 2).sum(1)).mean() < 0.35
    for c in range(3):
        some = np.flatnonzero(cell == c)[:5]
        if len(some):
            assert np.allclose(book.scores(x[:4], c, codes[some]), x[:4] @ back[some].T)
