"""Sums over all labelled rows, worked out by tasks, and what fits need of them: quantiles and the best cut.

A step takes the statistics (rows by columns) and labels of some rows and gives an array of fixed size;
the arrays are added up (or merged otherwise) within a task, and one for each task comes to the driver.
All rows count, and memory has nothing that grows with them. Rows lie in PARTS files, in order of their
ids, so that sums of doubles come out alike when they are worked out again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.texts import bound_batches

#: Files that labelled rows are dealt to: one array for each comes to the driver at most, unless Spark splits them as they are large.
PARTS = 24
#: Cells of a round of counting; rounds. Quantiles are met within the range of the rows by CELLS ** ROUNDS.
CELLS, ROUNDS = 256, 3
#: Cells and rounds in the search for a cut.
CUT_CELLS, CUT_ROUNDS = 4096, 4

Step = Callable[[np.ndarray, np.ndarray], np.ndarray]


def table(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length, without nulls, as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Rows:
    """Rows at hand: (rows, columns) and whether each is good."""

    def __init__(self, seen: np.ndarray, good: np.ndarray):
        self.seen, self.good = np.asarray(seen, float), np.asarray(good, bool)

    def total(self, step: Step, merge=np.add) -> np.ndarray | None:
        """Of all rows; None without rows."""
        return np.asarray(step(self.seen, self.good), float) if len(self.good) else None


class TableRows:
    """Rows of a table with the columns y (1: good) and seen (array of double)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("y", "seen")

    def total(self, step: Step, merge=np.add) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if len(batch):
                    got = np.asarray(step(table(batch.column("seen")), batch.column("y").to_numpy(zero_copy_only=False) == 1), float)
                    total = got if total is None else merge(total, got)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        bound_batches(self.rows.sparkSession)
        total = None
        for row in self.rows.mapInArrow(run, "total binary").collect():  # one for each task
            got = np.frombuffer(row.total)
            total = got if total is None else merge(total, got)
        return total


def ranges(rows: Rows | TableRows) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each column; there must be rows."""
    both = rows.total(lambda seen, good: np.concatenate([-seen.min(0), seen.max(0)]), np.maximum)
    least, most = np.split(both, 2)
    return -least, most


def quantiles(rows: Rows | TableRows, shares, n: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(columns, shares): the value of rank floor(share * (n - 1)) of each column, from counts of all n rows."""
    rank = np.floor(np.asarray(shares, float) * (n - 1))
    low, high = (np.repeat(x[:, None], len(rank), 1) for x in (least, most))
    for _ in range(ROUNDS):
        width = np.maximum((high - low) / CELLS, 1e-300)

        def step(seen: np.ndarray, good: np.ndarray, low=low, width=width) -> np.ndarray:
            counts = []
            for k, q in np.ndindex(low.shape):
                cell = np.clip(np.floor((seen[:, k] - low[k, q]) / width[k, q]), -1, CELLS) + 1
                counts.append(np.bincount(cell.astype(np.int64), minlength=CELLS + 2))
            return np.concatenate(counts)

        below = rows.total(step).reshape(*low.shape, CELLS + 2).cumsum(2)
        at = np.clip((below <= rank[:, None]).sum(2) - 1, 0, CELLS - 1)
        low, high = low + at * width, np.minimum(high, low + (at + 1) * width)
    return low


def best_cuts(rows: Rows | TableRows, score: Callable[[np.ndarray], np.ndarray], least: float, most: float, lost: float = 1.0, kept: float = 1.0, most_lost: float = np.inf) -> tuple[float, list[tuple[float, float]]]:
    """The least cost of a cut of the scores, and where cuts of that cost lie: (first, last) of each stretch without rows, ascending.

    Rows below a cut are lost. A cut costs ``lost`` for each good row below it and ``kept`` for each bad
    row that isn't; no more than ``most_lost`` good rows may be lost. All scores must be from ``least`` to
    ``most``. Cells that may hide a better cut are cut up again; what is left open after CUT_ROUNDS is
    narrower than (most - least) / CUT_CELLS and nearly always than the square of that.
    """
    edges = np.linspace(least, np.nextafter(most + 1e-9 * (1 + abs(most)), np.inf), CUT_CELLS + 1)
    for last in range(CUT_ROUNDS - 1, -1, -1):

        def step(seen: np.ndarray, good: np.ndarray, edges=edges) -> np.ndarray:
            cell = np.searchsorted(edges, score(seen), side="right")
            return np.concatenate([np.bincount(cell[own], minlength=len(edges) + 1) for own in (good, ~good)])

        good, bad = rows.total(step).reshape(2, -1)
        below = np.cumsum(good)[:-1]
        above = bad.sum() - np.cumsum(bad)[:-1]
        cost = np.where(below <= most_lost, lost * below + kept * above, np.inf)
        best = cost.min()
        hidden = lost * below[:-1] + kept * above[1:] < best
        open_ = np.flatnonzero(hidden & (good[1:-1] > 0) & (bad[1:-1] > 0) & (below[:-1] <= most_lost))
        open_ = open_[edges[open_ + 1] - edges[open_] > 1e-12 * (1 + np.abs(edges[open_]))]
        if not last or not len(open_):
            break
        share = np.linspace(0, 1, max(2, CUT_CELLS // len(open_)) + 1)
        finer = edges[open_, None] + (edges[open_ + 1] - edges[open_])[:, None] * share
        edges = np.unique(np.concatenate([finer.ravel(), edges[[0, -1]], edges[cost == best]]))
    at = np.flatnonzero(cost == best)
    apart = np.flatnonzero((np.diff(at) > 1) | (good[at[1:]] + bad[at[1:]] > 0)) + 1
    return float(best), [(float(edges[x[0]]), float(edges[x[-1]])) for x in np.split(at, apart)]
