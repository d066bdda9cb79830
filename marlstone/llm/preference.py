"""Quality classifier by Bradley-Terry ranking of preference pairs.

Labelled good rows are preferred to labelled bad ones. Each text gives statistics (lengths, symbols,
repeats, capitals, ...), spread over knots at their quantiles so that too little and too much
can both count against a text. The probability that a document is preferred to another is the
logistic function of the difference of their scores, a score is linear in the features, and the weights
come from the mean logistic loss over all pairs of a labelled good and a labelled bad row, by Newton's
method. Documents are then good above the score that parts the labels best.

All labelled rows count that are not held out, and all their pairs, though no pair is made: what a row
adds to the slope depends on its score and on how the scores of the other label are spread, so tasks
count scores on a grid, the driver folds the counts with the logistic function, and tasks add up rows
by the weights read from it. Loss and slope are as exact as a grid of GRID cells; the curvature
takes the scores at NODES of its points, which changes the steps but not where they end. Tasks return
arrays of fixed size (``sums``), and no statistics come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.quality import labelled, marks, rule_statistics, text_statistics
from marlstone.llm.sums import Rows, TableRows, best_cuts, quantiles, ranges, table
from marlstone.llm.texts import WordHashes, held_out, map_rows
from marlstone.plans.stash import Stash

#: Pairs of ``preference_pairs``.
PAIRS = 60_000
#: Points of the grid of scores; those at which the curvature takes them.
GRID, NODES = 8192, 64
#: Quantiles at which a statistic is bent.
KNOTS = (0.02, 0.1, 0.5, 0.9, 0.98)
#: Penalty on squared weights, a pair; steps of Newton's method.
PENALTY, STEPS = 1e-4, 25
#: The score that stands at the threshold.
AT_THRESHOLD = 0.3
#: Weight of a good row that is lost against a bad one that is kept, in the choice of the threshold.
GOOD_COUNTS = 2.0


@dataclass
class Ranking:
    """Standardised statistics and their bends, weights, and the score at the threshold."""

    middle: np.ndarray
    width: np.ndarray
    knots: np.ndarray  # by statistic
    weights: np.ndarray
    threshold: float

    def features(self, seen: np.ndarray) -> np.ndarray:
        """Statistics in units of their spread, within bounds, and what each exceeds its knots by."""
        x = np.clip((seen - self.middle) / self.width, -8, 8)
        bends = [np.maximum(x - k, 0) for k in self.knots.T]
        return np.concatenate([x, *bends], 1)

    def strengths(self, seen: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores: their differences are log odds of preference."""
        return self.features(seen) @ self.weights

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """From 0 to 1, AT_THRESHOLD at the threshold."""
        margin = self.strengths(seen) - self.threshold + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def preference_pairs(good: np.ndarray, seed: int = 23, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (preferred, other) of pairs of rows at hand: every bad row as often as another, each time with a good row drawn anew."""
    rng = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return rng.choice(better, pairs), np.resize(worse, pairs)


def newton_step(weights: np.ndarray, differences: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights after one step, pair by pair, on the mean of log(1 + exp(-difference . weights)) + penalty / 2 |weights|^2."""
    p = 1 / (1 + np.exp(np.clip(differences @ weights, -500, 500)))  # of the pair being the other way round
    gradient = -(differences.T @ p) / len(differences) + penalty * weights
    curve = (differences * (p * (1 - p))[:, None]).T @ differences / len(differences) + penalty * np.eye(len(weights))
    return weights - np.linalg.solve(curve, gradient)


def loss(weights: np.ndarray, differences: np.ndarray, penalty: float = PENALTY) -> float:
    return float(np.logaddexp(0, -differences @ weights).mean() + penalty / 2 * weights @ weights)


def best_quantile(strengths: np.ndarray, good: np.ndarray) -> float:
    """The quantile of the scores that parts the labels best; good rows below it count GOOD_COUNTS."""
    order = np.argsort(strengths, kind="stable")
    lost_good = np.append(0, np.cumsum(good[order]))
    kept_bad = (~good).sum() - np.append(0, np.cumsum(~good[order]))
    cost = GOOD_COUNTS * lost_good + kept_bad
    return float(np.mean(np.flatnonzero(cost == cost.min())) / len(good))


def middle_and_spread(rows: Rows | TableRows, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each column."""
    mean = rows.total(lambda seen, good: seen.sum(0)) / n
    return mean, np.sqrt(rows.total(lambda seen, good: ((seen - mean) ** 2).sum(0)) / n)


def bounds(model: Ranking, least: np.ndarray, most: np.ndarray) -> tuple[float, float]:
    """Between which the strengths of rows with statistics from ``least`` to ``most`` lie: each statistic's share bends at its knots only."""
    a, b = (np.clip((x - model.middle) / model.width, -8, 8) for x in (least, most))
    points = np.concatenate([a[:, None], np.clip(model.knots, a[:, None], b[:, None]), b[:, None]], 1)
    slopes = model.weights.reshape(1 + model.knots.shape[1], -1)
    share = points * slopes[0][:, None]
    for knot, slope in zip(model.knots.T, slopes[1:]):
        share += np.maximum(points - knot[:, None], 0) * slope[:, None]
    return float(share.min(1).sum()), float(share.max(1).sum())


def spread_on(points: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each score between two neighbouring points: number of the lower one, and the share of the upper one."""
    k = np.clip(np.searchsorted(points, s, side="right") - 1, 0, len(points) - 2)
    return k, np.clip((s - points[k]) / (points[k + 1] - points[k]), 0, 1)


def counted(points: np.ndarray, s: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Rows (or their weights) by point, shared between the points next to each score."""
    k, up = spread_on(points, s)
    weight = np.ones(len(s)) if weight is None else weight
    return np.bincount(k, weight * (1 - up), len(points)) + np.bincount(k + 1, weight * up, len(points))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class AllPairs:
    """Loss, slope and curvature of a ranking's weights over all pairs of a good and a bad row."""

    def __init__(self, rows: Rows | TableRows, model: Ranking, least: np.ndarray, most: np.ndarray, n_good: int, n_bad: int):
        self.rows, self.model, self.least, self.most, self.pairs = rows, model, least, most, n_good * n_bad

    def spread(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grid of scores, and how many good and bad rows stand at its points."""
        model = replace(self.model, weights=weights)
        low, high = bounds(model, self.least, self.most)
        grid = np.linspace(low - 1e-6, max(high, low + 1e-3) + 1e-6, GRID)

        def step(seen: np.ndarray, good: np.ndarray) -> np.ndarray:
            s = model.strengths(seen)
            return np.concatenate([counted(grid, s[good]), counted(grid, s[~good])])

        good, bad = self.rows.total(step).reshape(2, -1)
        return grid, good, bad

    def loss(self, weights: np.ndarray, at: tuple, penalty: float = PENALTY) -> float:
        grid, good, bad = at
        apart = np.arange(GRID - 1, -GRID, -1) * (grid[1] - grid[0])  # bad less good
        return float(good @ np.convolve(np.logaddexp(0, apart), bad, "valid")) / self.pairs + penalty / 2 * float(weights @ weights)

    def slope_and_curve(self, weights: np.ndarray, at: tuple, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
        grid, good, bad = at
        model = replace(self.model, weights=weights)
        apart = np.arange(GRID - 1, -GRID, -1) * (grid[1] - grid[0])
        p = logistic(apart)
        # of a row with the score of a point: chances that a row of the other label is put wrong, summed
        wrong_good, wrong_bad = np.convolve(p, bad, "valid") / self.pairs, np.convolve(logistic(-apart), good, "valid") / self.pairs
        spread = p * (1 - p)
        heavy = good * np.convolve(spread, bad, "valid") + bad * np.convolve(spread, good, "valid")
        share = np.cumsum(heavy) / max(heavy.sum(), 1e-300)
        nodes = grid[np.unique(np.concatenate([[0, GRID - 1], np.searchsorted(share, np.linspace(0, 1, NODES - 1)[1:-1]).clip(0, GRID - 1)]))]
        between = logistic(nodes[:, None] - nodes)
        between = between * (1 - between) / self.pairs
        own_good, own_bad = between @ counted(nodes, grid, bad), between @ counted(nodes, grid, good)
        wide, m = len(weights), len(nodes)

        def step(seen: np.ndarray, is_good: np.ndarray) -> np.ndarray:
            x = model.features(seen)
            s = x @ weights
            pull = np.where(is_good, -np.interp(s, grid, wrong_good), np.interp(s, grid, wrong_bad))
            bent = np.where(is_good, np.interp(s, nodes, own_good), np.interp(s, nodes, own_bad))
            k, up = spread_on(nodes, s)
            on = np.zeros((len(s), 2, m))  # by label and node
            each, label = np.arange(len(s)), is_good.astype(np.int64)
            on[each, label, k] = 1 - up
            on[each, label, k + 1] += up
            return np.concatenate([x.T @ pull, ((x * bent[:, None]).T @ x).ravel(), (on.reshape(len(s), -1).T @ x).ravel()])

        slope, curve, sums = np.split(self.rows.total(step), [wide, wide + wide * wide])
        of_bad, of_good = sums.reshape(2, m, wide)
        cross = of_good.T @ between @ of_bad
        return slope + penalty * weights, curve.reshape(wide, wide) - cross - cross.T + penalty * np.eye(wide)


def fit_rows(rows: Rows | TableRows, wide: int) -> Ranking:
    """A ranking from all rows, with ``wide`` statistics; without both labels all documents score alike."""
    model = Ranking(np.zeros(wide), np.ones(wide), np.zeros((wide, len(KNOTS))), np.zeros(wide * (1 + len(KNOTS))), 0.0)
    counts = rows.total(lambda seen, good: np.array([good.sum(), (~good).sum()]))
    n_good, n_bad = (0, 0) if counts is None else map(int, counts)
    n = n_good + n_bad
    if not n_good or not n_bad:
        share = min(max(n_good / n if n else 0.5, 1e-3), 1 - 1e-3)
        model.threshold = float(np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)) - np.log(share / (1 - share)))
        return model
    least, most = ranges(rows)
    found = quantiles(rows, (0.5, *KNOTS), n, least, most)
    spread = middle_and_spread(rows, n)[1]
    model.middle, model.width = found[:, 0], np.where(spread > 1e-9, spread, 1.0)
    model.knots = (found[:, 1:] - model.middle[:, None]) / model.width[:, None]
    pairs = AllPairs(rows, model, least, most, n_good, n_bad)
    weights = model.weights
    at = pairs.spread(weights)
    now = pairs.loss(weights, at)
    for _ in range(STEPS):
        slope, curve = pairs.slope_and_curve(weights, at)
        step, size = -np.linalg.solve(curve, slope), 1.0
        if -slope @ step < 1e-9:
            break
        while True:
            there = pairs.spread(weights + size * step)
            then = pairs.loss(weights + size * step, there)
            if then <= now + 1e-8 or size < 1e-3:  # the grid tells no less apart
                break
            size /= 2
        weights, at, now = weights + size * step, there, then
    model.weights = np.round(weights, 6)  # beyond what the order of sums can change
    _, cuts = best_cuts(rows, model.strengths, *bounds(model, least, most), lost=GOOD_COUNTS)
    first, last = max(cuts, key=lambda c: c[1] - c[0])
    model.threshold = (first + last) / 2
    return model


def fit(seen: np.ndarray, good: np.ndarray) -> Ranking:
    """A ranking from statistics and labels at hand."""
    seen = np.asarray(seen, float)
    return fit_rows(Rows(seen, good), seen.shape[1] if seen.ndim == 2 else 0)


def fit_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int | None = None) -> Ranking:
    """A ranking from all labelled rows that are not held out, or ``rows`` of them (by least hash of the id).

    Rows without a label, with labels other than 0 and 1 or without a document are left out; an id
    labelled more than once counts with its largest label, one with several documents with the
    least statistics.
    """
    own = marks(labels, doc_id, label, rows)
    if rows is not None:
        docs = docs.join(F.broadcast(own.select(F.col("doc_id").alias("own_id"))), F.col(doc_id).cast("long") == F.col("own_id"), "left_semi")
    return fit_statistics(text_statistics(docs, doc_id, text), own)


def fit_statistics(statistics: DataFrame, own: DataFrame) -> Ranking:
    """A ranking from the statistics of all marked rows."""
    stash = Stash(statistics.sparkSession)
    got = labelled(stash, statistics, own)
    model = fit_rows(TableRows(got), len(rule_statistics("", WordHashes())[1]))
    stash.drop(got)
    return model


def score_quality(docs: DataFrame, model: Ranking, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Null and empty texts have the score of a text without words. A null doc_id stays null and is
    not held out. Repeated rows get equal scores; a score at the threshold is predicted good. Whole
    texts are read, and nothing but the text; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def make():
        ranking, hashes = shared.value, WordHashes()

        def step(batch: pa.RecordBatch) -> dict:
            seen = np.array([rule_statistics(t, hashes)[1] for t in batch.column("text").to_pylist()], float)
            return {"doc_id": batch.column("doc_id"), "score": ranking.scores(seen)}

        return step

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return judged(map_rows(rows, SCORES, make))


SCORES = "doc_id long, score double"


def judged(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= AT_THRESHOLD).cast("int").alias("predicted"))


def score_by_labels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``score_quality`` by a ranking of ``fit_on`` on the same documents, whose texts are read once: their statistics are written."""
    statistics = Stash(docs.sparkSession).put(text_statistics(docs, doc_id, text))
    shared = docs.sparkSession.sparkContext.broadcast(fit_statistics(statistics, marks(labels, doc_id, label)))  # fixed size

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": shared.value.scores(table(batch.column("seen")))}

    return judged(map_rows(statistics, SCORES, make))
