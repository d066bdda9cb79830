"""Ranked lexical search by WAND, one shard of documents at a time.

One scan of the texts writes an index: a row is a shard of some ten thousand documents at most, with the
postings of the query terms in it (document numbers in order and counts, term after term) and its
documents' ids and lengths. Document frequencies are added up from the shards. Then each shard is
searched alone: a term's impact on a document is a whole number, and its largest in the shard
bounds what the term can add. Lists stand in order of their next documents; the pivot is the first
at which the bounds add up to the least score on the heap of the ten best, and everything before it is
skipped. A task goes on with its heaps from one shard to the next; heaps of tasks are merged by
rank, in groups of tasks first.

Items are taken on in blocks of bounded size, so what is broadcast doesn't grow with their number.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.texts import bound_batches, give_back, sliced
from marlstone.plans.stash import Stash

# The numbers of the score.
SCALE, UNIT, SATURATION, BASE, PERCENT = 1000, 1_000_000_000, 8, 25, 75
#: Code points of the items that are searched for at a time, about.
BLOCK_CHARS = 2_000_000
#: Bytes of text of a shard, at most but for one row, and its documents.
SHARD_BYTES, SHARD_DOCS = 24_000_000, 16_000
#: Tasks whose heaps are merged first.
TASKS_A_GROUP = 256

#: Terms are runs of ASCII letters, ASCII digits and bytes of characters beyond; only A-Z are lowered.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; null has none."""
    return text.translate(_FOLD).split() if text else []


@dataclass
class Shard:
    """Postings of the query terms: ``docs`` and ``counts`` from ``starts[i]`` to ``starts[i + 1]`` are of ``terms[i]``."""

    ids: np.ndarray  # doc_id by document number, in order
    null: np.ndarray  # whether the id is null
    sizes: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    counts: np.ndarray

    FIELDS = (("ids", "<i8"), ("null", "?"), ("sizes", "<i8"), ("terms", "<i4"), ("starts", "<i8"), ("docs", "<i4"), ("counts", "<i4"))

    def packed(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.FIELDS}

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> "Shard":
        return cls(**{name: np.frombuffer(row[name], kind) for name, kind in cls.FIELDS})


INDEX = "n_docs long, n_terms long, held array<int>, found array<int>, " + ", ".join(f"`{name}` binary" for name, _ in Shard.FIELDS)


class ShardBuilder:
    """Takes texts until the shard is full; only documents with a query term are kept."""

    def __init__(self, numbers: dict[bytes, int]):
        self.numbers = numbers
        self.clear()

    def clear(self) -> None:
        self.bytes = self.n_docs = self.n_terms = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.hits: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = terms(text)
        self.bytes += len(text or b"")
        self.n_docs += bool(found)
        self.n_terms += len(found)
        hits = [x for x in map(self.numbers.get, found) if x is not None]
        if hits:
            at, n = np.unique(np.array(hits, np.int32), return_counts=True)
            self.ids.append(doc_id)
            self.sizes.append(len(found))
            self.hits.append(np.stack([at, n.astype(np.int32)]))

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def shard(self) -> Shard:
        null = np.array([x is None for x in self.ids], bool)
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)
        order = np.lexsort((ids, ~null))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        each = np.array([h.shape[1] for h in self.hits], np.int64)
        at, n = np.concatenate(self.hits, 1) if self.hits else np.empty((2, 0), np.int32)
        docs = np.repeat(place, each)
        by = np.lexsort((docs, at))
        named, starts = np.unique(at[by], return_index=True)
        return Shard(ids[order], null[order], np.array(self.sizes, np.int64)[order], named, np.append(starts, len(by)), docs[by], n[by])

    def row(self) -> pa.RecordBatch:
        shard = self.shard()
        row = {"n_docs": self.n_docs, "n_terms": self.n_terms, "held": shard.terms.tolist(), "found": np.diff(shard.starts).astype(np.int32).tolist(), **shard.packed()}
        self.clear()
        kinds = {"n_docs": pa.int64(), "n_terms": pa.int64(), "held": pa.list_(pa.int32()), "found": pa.list_(pa.int32())}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))


def shards(docs: DataFrame, numbers: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard: numbers of documents and terms, frequencies of the query terms, and the postings."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # the terms of one block of items
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = ShardBuilder(shared.value)
        for part in sliced(batches):
            for i, x in zip(part.column("doc_id").to_pylist(), part.column("text")):
                builder.add(i, x.as_py())
                if builder.full():
                    yield builder.row()
        if builder.bytes or builder.n_docs:
            yield builder.row()
        builder = part = None
        give_back()

    bound_batches(docs.sparkSession)
    return rows.mapInArrow(run, INDEX)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to the scores of documents, before its weight."""
    length = BASE + (PERCENT * sizes * n_docs) // max(1, n_terms)
    counts = counts.astype(np.int64)
    return (UNIT * counts) // (SCALE * counts + SATURATION * length)


def wand(lists: list[tuple[int, int, list[int], list[int]]], ids: list, heap: list, k: int) -> int:
    """Put the documents of one shard on a heap of the ``k`` best: (score, negative id) pairs, least first.

    A list is (weight, largest impact, documents in order, impacts). A document that can at best reach the least
    score on the full heap is still looked at, as its id may be the smaller one. Gives the number of
    documents whose scores were worked out.
    """
    end = 1 << 60
    cursors = [[docs[0], 0, weight * most, docs, values, weight] for weight, most, docs, values in lists if docs]
    least = heap[0][0] if len(heap) == k else 1
    looked = 0
    while cursors:
        cursors.sort(key=_next)
        bound = 0
        for pivot, cursor in enumerate(cursors):
            bound += cursor[2]
            if bound >= least:
                break
        else:
            break
        at = cursor[0]
        if at == end:
            break
        if cursors[0][0] == at:
            score = 0
            for cursor in cursors:
                if cursor[0] != at:
                    break
                i = cursor[1]
                score += cursor[5] * cursor[4][i]
                cursor[1] = i = i + 1
                cursor[0] = cursor[3][i] if i < len(cursor[3]) else end
            looked += 1
            if score >= least:
                entry = (score, ids[at])
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == k:
                    least = heap[0][0]
        else:
            for cursor in cursors[:pivot]:
                if cursor[0] < at:
                    docs = cursor[3]
                    cursor[1] = i = bisect_left(docs, at, cursor[1] + 1)
                    cursor[0] = docs[i] if i < len(docs) else end
        if cursors[-1][0] == end:
            cursors = [c for c in cursors if c[0] != end]
    return looked


def _next(cursor: list) -> int:
    return cursor[0]


#: Below the negative of any 64-bit id, as null ids come first: heaps keep the largest of equal scores.
_NULL_FIRST = 1 << 63


class Searcher:
    """Searches shards one after another and keeps a heap for each item.

    ``items`` lists the (term, weight times repeats) pairs of each item.
    """

    def __init__(self, items: list[list[tuple[int, int]]], n_docs: int, n_terms: int, k: int):
        self.items, self.n_docs, self.n_terms, self.k = items, n_docs, n_terms, k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        self.looked = 0

    def search(self, shard: Shard) -> None:
        sizes = shard.sizes
        value = impacts(shard.counts, sizes[shard.docs], self.n_docs, self.n_terms)
        order = [_NULL_FIRST if null else -i for i, null in zip(shard.ids.tolist(), shard.null.tolist())]
        spans = {t: (a, b) for t, a, b in zip(shard.terms.tolist(), shard.starts[:-1].tolist(), shard.starts[1:].tolist())}
        listed: dict[int, tuple[int, list[int], list[int]]] = {}
        for item, heap in zip(self.items, self.heaps):
            lists = []
            for term, weight in item:
                if term in spans:
                    if term not in listed:
                        a, b = spans[term]
                        listed[term] = (int(value[a:b].max()), shard.docs[a:b].tolist(), value[a:b].tolist())
                    lists.append((weight, *listed[term]))
            self.looked += wand(lists, order, heap, self.k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item.

    Null, empty and term-less texts and items have no terms: such a document is never found and
    doesn't count in N, such an item has no rows. Equal scores go by ascending doc_id, null first;
    documents that repeat a row are found each. Items that repeat a row count once; other items
    that share an id are ranked each on its own. Empty tables give an empty result; other columns
    are not read, whatever their names. All documents are searched for every item.
    """
    spark, stash = docs.sparkSession, Stash(docs.sparkSession)
    asked = stash.put(items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct())
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    out = None
    for block in range(blocks):
        found = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()  # about block_chars
        best = _searched(docs, found, k, doc_id, text, stash)
        out = best if out is None else out.unionByName(best)
    stash.drop(asked)
    return out


def _searched(docs: DataFrame, found: pa.Table, k: int, doc_id: str, text: str, stash: Stash) -> DataFrame:
    """The result for one block of items, written."""
    spark = docs.sparkSession
    wanted = [Counter(terms(x.encode("utf-8", "replace"))) for x in found.column("text").to_pylist()]
    numbers = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    index = stash.put(shards(docs, numbers, doc_id, text))
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total.n or 0, total.l or 0
    pairs = index.select(F.explode(F.arrays_zip("held", "found")).alias("x"))
    df = dict(pairs.groupBy("x.held").agg(F.sum("x.found").alias("n")).toArrow().to_pandas().itertuples(index=False))  # at most the block's terms
    weight = {t: term_weight(n_docs, df[i]) for t, i in numbers.items() if i in df}
    plans = [[(numbers[t], weight[t] * n) for t, n in sorted(item.items()) if weight.get(t, 0) > 0] for item in wanted]
    shared = spark.sparkContext.broadcast((plans, n_docs, n_terms, k))  # the block's terms and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value)
        for batch in batches:
            for at in range(len(batch)):
                searcher.search(Shard.unpacked({name: batch.column(name)[at].as_py() for name, _ in Shard.FIELDS}))
        rows = [(i, None if key == _NULL_FIRST else -key, score) for i, heap in enumerate(searcher.heaps) for score, key in heap]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])
        searcher = batch = None
        give_back()

    heaps = index.select(*[name for name, _ in Shard.FIELDS]).mapInArrow(run, "item int, doc_id long, score long")
    heaps = heaps.withColumn("group", F.floor(F.spark_partition_id() / TASKS_A_GROUP))
    for by in (["item", "group"], ["item"]):
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        heaps = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(wanted)), pa.int32()), "item_id": found.column("item_id")}))
    best = stash.put(heaps.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # the block's items
    stash.drop(index)
    return best
