"""Fits on all labelled rows, by sums of tasks, against plain versions on the rows at hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import preference, quality
from marlstone.llm.sums import Rows, TableRows, best_cuts, quantiles, ranges


def mixed_rows(seed, n=600):
    rng = np.random.default_rng(seed)
    seen = np.concatenate([rng.normal(size=(n, 3)), rng.integers(0, 3, (n, 1)), np.ones((n, 1))], 1)
    return seen, seen[:, 0] - np.abs(seen[:, 1]) + 0.5 * rng.normal(size=n) > -1.2


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_is_that_of_all_pairs(seed):
    seen, good = mixed_rows(seed)
    model = preference.fit(seen, good)
    x = model.features(seen)
    pairs = (x[good][:, None] - x[~good][None]).reshape(-1, x.shape[1])
    weights = np.zeros(x.shape[1])
    for _ in range(15):
        weights = preference.newton_step(weights, pairs)
    assert abs(preference.loss(model.weights, pairs) - preference.loss(weights, pairs)) < 1e-6
    assert np.abs(x @ weights - x @ model.weights).max() < 0.05
    s = x @ model.weights
    cost = lambda c: preference.GOOD_COUNTS * (good & (s < c)).sum() + (~good & (s >= c)).sum()
    assert cost(model.threshold) == min(map(cost, [*s, np.inf]))
    whole = preference.AllPairs(Rows(seen, good), model, *ranges(Rows(seen, good)), int(good.sum()), int((~good).sum()))
    at = whole.spread(model.weights)
    slope, curve = whole.slope_and_curve(model.weights, at)
    p = 1 / (1 + np.exp(pairs @ model.weights))
    assert np.allclose(slope, preference.PENALTY * model.weights - pairs.T @ p / len(pairs), atol=1e-6)
    assert np.linalg.eigvalsh(curve).min() > 0 and abs(whole.loss(model.weights, at) - preference.loss(model.weights, pairs)) < 1e-5


@pytest.mark.parametrize("seed", range(6))
def test_cuts_and_quantiles_are_exact(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    s, good = np.round(rng.normal(size=n), int(rng.integers(0, 6))), rng.random(n) < 0.7
    most_lost = [np.inf, 3, 0][seed % 3]
    rows = Rows(s[:, None], good)
    cost = lambda c: 2 * (good & (s < c)).sum() + (~good & (s >= c)).sum() if (good & (s < c)).sum() <= most_lost else np.inf
    best, cuts = best_cuts(rows, lambda x: x[:, 0], s.min() - 1, s.max() + 2, 2.0, 1.0, most_lost)
    assert best == min(map(cost, [*s, np.inf]))
    for first, last in cuts:
        assert cost(first) == cost(last) == cost((first + last) / 2) == best
    shares = (0.0, 0.02, 0.5, 0.98, 1.0)
    got = quantiles(rows, shares, n, *ranges(rows))
    assert np.allclose(got, np.quantile(s[:, None], shares, axis=0, method="lower").T, atol=1e-6)


def test_sums_of_tables_are_those_of_rows(spark):
    seen, good = mixed_rows(3)
    rows = spark.createDataFrame([(int(g), x.tolist()) for g, x in zip(good, seen)], "y int, seen array<double>").repartition(5)
    here, there = preference.fit(seen, good), preference.fit_rows(TableRows(rows), seen.shape[1])
    assert np.allclose(here.scores(seen), there.scores(seen), atol=1e-3) and np.allclose(here.knots, there.knots)
    assert TableRows(rows.limit(0)).total(lambda seen, good: seen.sum(0)) is None


def test_forest_ends_paths_by_all_good_rows():
    seen, good = mixed_rows(4)
    forest = quality.Forest.grow(seen[good], seen)
    ended = forest.ended(Rows(seen, good))
    x = seen[:5]
    want = np.zeros(5)
    for t in range(quality.TREES):
        of_all = list(forest.leaves(seen[good]))[t]
        for i, leaf in enumerate(list(forest.leaves(x))[t]):
            n = (of_all == leaf).sum()
            want[i] += forest.depth[t, leaf] + (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else n == 2)
    assert np.allclose(ended.path(x), want / quality.TREES)


def test_all_labelled_rows_count(spark):
    """What only labelled rows show that the former samples (6000 and 3000 of the lowest hashes) left out."""
    ids = spark.range(9000).select(F.col("id").alias("doc_id")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    ids = [x.doc_id for x in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    assert len(ids) > 7000
    rng = np.random.default_rng(0)
    plain = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 90)))
    marked = lambda: plain().replace(" ", " # ")
    rows = [(i, marked() if k >= 6000 and k % 4 == 0 else plain()) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int("#" not in t)) for i, t in rows], "doc_id long, quality int")
    new = spark.createDataFrame([(k, marked() if k % 2 else plain()) for k in range(40)], "doc_id long, text string")
    got = preference.score_quality(new, preference.fit_on(docs, labels)).collect()
    assert all(x.predicted == (x.doc_id % 2 == 0) for x in got)
    got = quality.quality_verdicts(new, quality.fit_on(docs, labels)).collect()
    assert not any(x.kept for x in got if x.doc_id % 2) and sum(x.kept for x in got) >= 19
    whole = docs.unionByName(new.withColumn("doc_id", F.lit(None).cast("long")))
    assert {(x.doc_id, x.kept) for x in quality.verdicts_by_labels(whole, labels).where("doc_id is not null and n_symbols > 0").collect()} == {(i, False) for i, t in rows if "#" in t}
    assert preference.score_by_labels(whole, labels).where("doc_id is null").count() == 40
