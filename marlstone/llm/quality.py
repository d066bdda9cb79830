"""Quality rules with an isolation forest on their statistics.

Each text gives the statistics that quality rules look at (lengths, symbols, repeated lines and
words, capitals, ...). A forest of random splits is grown on the statistics of documents labelled
good, half of the splits where these leave most of the range of all labelled rows empty, so that a
statistic on which good documents agree still splits: what falls out of the trees after a few splits is unlike them. The
threshold on the mean path length is calibrated on all labelled rows of both kinds that are not among
those that trees draw from. The splits of a tree come from 256 rows, as in all isolation forests, drawn
from all of the latter; a path that they cut short ends by the number of all good rows that end with it,
and ranges and threshold count all labelled rows too, by sums of the tasks. So a kind of good text that
few of a tree's 256 rows show isn't taken for an empty range. Rows whose id has no remainder (crc32,
modulo 5) are held out from both, to measure on.

The splits of empty range are what makes the forest work here: of the held-out bad rows of sf0.1 that
pass the base rules it rejects 95 to 100 percent and no good one, without such splits none (twelve
seeds), as bad rows stand out in one statistic on which good ones agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.sums import PARTS, Rows, TableRows, best_cuts, ranges, table
from marlstone.llm.texts import SPACES, WordHashes, held_out, map_rows, shingles, words
from marlstone.plans.stash import Stash

#: Trees, and rows that each is grown on, drawn from all.
TREES, SUBSAMPLE = 60, 256
#: Share of the labelled rows that forests grow on; the rest calibrates the threshold.
GROWN = 0.6
#: Splits that go where good rows leave the range empty.
GUIDED = 0.5
#: Share of good labelled rows that the threshold may reject.
MOST_REJECTED = 0.004
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_statistics(text: str | None, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """The base counts, and the statistics that the forest sees."""
    text = text or ""
    found = words(text)
    n = len(found)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = [text.count(c) for c in SYMBOLS[1:-1]]
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeated = distinct = 0
    if n:
        h = hashes.of(found)
        distinct = len(set(found))
        if n >= 3:
            window = shingles(h, 3)
            _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
            again = np.flatnonzero(counts[inverse] > 1)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[again + k] = True
            repeated = int(covered.sum())
    base = [n, word_chars, sum(symbols), dup, repeated]
    per = 1 / max(1, n)
    chars = max(1, word_chars)
    upper = _capitals(text)
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, ".,;:!?"))
    seen = [
        np.log1p(n), word_chars * per, (sum(symbols) * per) ** 0.5, dup / max(1, len(lines)), repeated * per,
        distinct / max(1.0, n**0.8), (upper / chars) ** 0.5, (digits / chars) ** 0.5, marks * per, (text.count("!") * per) ** 0.5,
        (text.count("|") * per) ** 0.5, np.log1p(n / max(1, len(lines))),
    ]
    return base, [float(x) for x in seen]


def _capitals(text: str) -> int:
    """Characters that lower case changes, at C speed."""
    if text.isascii():
        raw = np.frombuffer(text.encode(), np.uint8)
        return int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    low = text.lower()
    a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    b = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    return int(np.count_nonzero(a != b)) if len(a) == len(b) else sum(map(str.isupper, text))


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), cut, left child (right: + 1) and depth, with the leaf's own share once ``ended``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    threshold: float = -np.inf

    @classmethod
    def grow(cls, x: np.ndarray, around: np.ndarray | None = None, seed: int = 5) -> "Forest":
        """Trees on the rows of ``x``; ``around`` are rows that widen the ranges of splits."""
        rng = np.random.default_rng(seed)
        size = min(SUBSAMPLE, len(x))
        deepest = 2 * int(np.ceil(np.log2(max(2, size))))
        around = x if around is None else np.concatenate([x, around])
        own = rng.permutation(len(x))[: TREES * size].reshape(TREES, size) if len(x) >= TREES * size else [rng.choice(len(x), size, replace=False) for _ in range(TREES)]
        trees = []
        for drawn in own:
            nodes = [[-1, 0.0, 0, 0.0]]
            todo = [(0, x[drawn], 0, around.min(0), around.max(0))]
            while todo:
                k, rows, level, low, high = todo.pop()
                if level >= deepest or len(rows) <= 1 or not (high > low).any():
                    nodes[k][3] = level
                    continue
                a, b = rows.min(0), rows.max(0)
                empty = np.where(high > low, 1 - (b - a) / np.where(high > low, high - low, 1), 0)
                if rng.random() < GUIDED and empty.sum() > 0:  # where the rows leave most of the range empty
                    f = int(rng.choice(len(a), p=empty / empty.sum()))
                    c = rng.uniform(low[f], high[f])
                else:
                    f = int(rng.choice(np.flatnonzero(b > a) if (b > a).any() else np.flatnonzero(high > low)))
                    c = rng.uniform(a[f], b[f])
                nodes[k][:3] = f, c, len(nodes)
                nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
                inside, above, below = rows[:, f] <= c, low.copy(), high.copy()
                above[f] = below[f] = c
                todo += [(nodes[k][2], rows[inside], level + 1, low, below), (nodes[k][2] + 1, rows[~inside], level + 1, above, high)]
            trees.append(nodes)
        most = max(map(len, trees))
        flat = np.array([t + [[-1, 0.0, 0, 0.0]] * (most - len(t)) for t in trees], float)
        return cls(flat[..., 0].astype(np.int64), flat[..., 1], flat[..., 2].astype(np.int64), flat[..., 3])

    def ended(self, rows: Rows | TableRows) -> "Forest":
        """Leaves add the usual path among all good rows that end in them, as if trees had grown on all."""

        def step(seen: np.ndarray, good: np.ndarray) -> np.ndarray:
            return np.concatenate([np.bincount(at, minlength=self.cut.shape[1]) for at in self.leaves(seen[good])])

        counts = rows.total(step).reshape(self.cut.shape)
        return replace(self, depth=self.depth + usual_path(counts))

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of each row."""
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, at]
                inner = f >= 0
                if not inner.any():
                    break
                beyond = x[rows, np.maximum(f, 0)] > self.cut[t, at]
                at = np.where(inner, self.left[t, at] + beyond, at)
            yield at

    def path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row."""
        total = np.zeros(len(x))
        for depth, at in zip(self.depth, self.leaves(x)):
            total += depth[at]
        return total / max(1, len(self.feature))


#: Has no trees and rejects nothing.
NO_FOREST = Forest(*(np.zeros((0, 1)) for _ in range(4)))


def usual_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows, which ends a path cut short."""
    m = np.maximum(n, 2)
    return np.where(n > 2, 2.0 * (np.log(m - 1) + 0.5772156649) - 2.0 * (m - 1) / m, n == 2)


def calibrated(rows: Rows | TableRows, forest: Forest) -> float:
    """The path length below which most bad rows fall and at most MOST_REJECTED of the good ones, by all rows."""
    counts = rows.total(lambda seen, good: np.array([good.sum(), (~good).sum()]))
    if counts is None or not counts.all():
        return -np.inf
    n_good, n_bad = counts
    deepest = float(forest.depth.max())
    cost, cuts = best_cuts(rows, forest.path, 0.0, deepest, 1 / n_good, 1 / n_bad, int(MOST_REJECTED * n_good))
    return cuts[0][1] if cost < 1 else -np.inf  # as little as rejects as much


STATISTICS = "doc_id long, base array<long>, seen array<double>"


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base counts and statistics of each row, from its whole text."""

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> dict:
            pairs = [rule_statistics(t, hashes) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "base": [b for b, _ in pairs], "seen": [x for _, x in pairs]}

        return step

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), STATISTICS, make)


def marks(labels: DataFrame, doc_id: str, label: str, rows: int | None = None) -> DataFrame:
    """doc_id and y of ids labelled 0 or 1 that are not held out, the largest label of each; ``rows`` of the lowest hashes, or all."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).cast("long").alias("doc_id"))
    own = own.agg(F.max(label).cast("int").alias("y"))
    return own if rows is None else own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled(stash: Stash, statistics: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id, y, base and seen of all marked rows, one an id (that of the least statistics), written in PARTS files."""
    got = statistics.where("doc_id is not null").join(own.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min(F.struct("base", "y", "seen")).alias("row"))
    return stash.put(got.select("doc_id", "row.*").repartition(PARTS, "doc_id").sortWithinPartitions("doc_id"))


def fit_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int | None = None) -> Forest:
    """Forest and threshold from all labelled rows that are not held out, or ``rows`` of them (by least hash of the id).

    Rows without a label, with labels other than 0 and 1 or without a document are left out; an id
    labelled more than once counts with its largest label, one with several documents with the
    least statistics. Without good rows there are no trees.
    """
    own = marks(labels, doc_id, label, rows)
    if rows is not None:
        docs = docs.join(F.broadcast(own.select(F.col("doc_id").alias("own_id"))), F.col(doc_id).cast("long") == F.col("own_id"), "left_semi")
    return fit_statistics(text_statistics(docs, doc_id, text), own)


def fit_statistics(statistics: DataFrame, own: DataFrame) -> Forest:
    """Forest and threshold from the statistics of all marked rows: trees draw from all good rows that grow; ends of paths, ranges and threshold count all rows."""
    stash = Stash(statistics.sparkSession)
    got = labelled(stash, statistics, own)
    passed = got.where((F.col("base")[0] >= LEAST_WORDS) & (2 * F.col("base")[4] <= F.col("base")[0]))  # others fail the base rules anyway
    grows = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1000)) < int(1000 * GROWN)
    drawn = passed.where(grows & (F.col("y") == 1)).orderBy(F.xxhash64(F.lit(2), "doc_id"), "doc_id").limit(TREES * SUBSAMPLE)  # what trees are grown on, each on its own
    x = np.array(drawn.select("seen").toArrow().column("seen").to_pylist(), float)
    if not len(x):
        stash.drop(got)
        return NO_FOREST
    grown = TableRows(passed.where(grows))
    forest = Forest.grow(x, np.stack(ranges(grown))).ended(grown)
    forest.threshold = calibrated(TableRows(passed.where(~grows)), forest)
    stash.drop(got)
    return forest


def quality_verdicts(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, path (mean path length) and kept of each row.

    Null and blank texts have no words, fail the base rules and are not kept. Without labelled
    rows the forest has no trees and only the base rules count. A null doc_id stays null; repeated
    rows get equal verdicts; an empty table gives an empty result. A path as long as the threshold
    is kept. Whole texts are read; other columns are not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # fixed size

    def make():
        trees, hashes = shared.value, WordHashes()

        def step(batch: pa.RecordBatch) -> dict:
            pairs = [rule_statistics(t, hashes) for t in batch.column("text").to_pylist()]
            return verdicts(trees, batch.column("doc_id"), np.array([b for b, _ in pairs], np.int64), np.array([s for _, s in pairs], float))

        return step

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(rows, VERDICTS, make)


VERDICTS = ", ".join(["doc_id long", *(f"{x} long" for x in BASE), "base_failed boolean, path double, kept boolean"])


def verdicts(forest: Forest, ids: pa.Array, base: np.ndarray, seen: np.ndarray) -> dict:
    failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > 50 * base[:, 0])
    path = forest.path(seen)
    return dict(zip(BASE, base.T)) | {"doc_id": ids, "base_failed": failed, "path": path, "kept": ~failed & (path >= forest.threshold)}


def verdicts_by_labels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``quality_verdicts`` by a forest of ``fit_on`` on the same documents, whose texts are read once: their statistics are written."""
    statistics = Stash(docs.sparkSession).put(text_statistics(docs, doc_id, text))
    shared = docs.sparkSession.sparkContext.broadcast(fit_statistics(statistics, marks(labels, doc_id, label)))  # fixed size

    def make():
        return lambda batch: verdicts(shared.value, batch.column("doc_id"), table(batch.column("base")), table(batch.column("seen")))

    return map_rows(statistics, VERDICTS, make)
