"""Chunks of documents as rows: fixed and snapped windows, paragraphs, packing by structure, plans by size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.deal import dealt


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, chunk): windows of a fixed stride, by expressions only."""
    stride = size - overlap
    count = F.greatest(F.ceil((F.length(text) - overlap) / stride), F.lit(1)).cast("int")
    rows = docs.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    return rows.select(key, "chunk_index", F.col(text).substr(F.col("chunk_index") * stride + 1, F.lit(size)).alias("chunk"))


def snapped(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of windows that end after their last full stop, and always move on."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            stop = text.rfind(".", start, end)
            end = stop + 1 if stop > start else end
        yield start, end
        start = len(text) if end >= len(text) else max(end - overlap, start + 1)


#: Rows of chunks that a worker hands on at a time, and bytes of texts that it holds as strings.
ROWS_A_TIME, BYTES_A_TIME = 2000, 1 << 20


def _few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about BYTES_A_TIME, of one row at least."""
    rows = max(1, batch.num_rows * BYTES_A_TIME // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def snapped_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, start_pos, end_pos, chunk) of such windows: sequential, so in Arrow batches; null and empty texts have none.

    A worker holds a batch as Spark sends it, strings of a small slice of it, and ROWS_A_TIME chunks.
    """
    kind = dict(docs.dtypes)[key]
    names = [key, "chunk_index", "start_pos", "end_pos", "chunk"]
    ints = [pa.int32()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def taken() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, *ints, pa.string()])], names=names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for some in _few(batch):
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    for n, (a, b) in enumerate(snapped(t or "", size, overlap)):
                        out.append((k, n, a, b, t[a:b]))
                        if len(out) == ROWS_A_TIME:
                            yield taken()
            if out:
                yield taken()
            batch = some = None
            pa.default_memory_pool().release_unused()

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_index int, start_pos int, end_pos int, chunk string")


def overlapping(docs: DataFrame, size: int = 8000, ratio: float = 0.2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Snapped windows whose overlap is a share of their size."""
    return snapped_chunks(docs, size, int(size * ratio), key, text)


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraph, chunk): non-blank stretches between blank lines."""
    rows = docs.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("paragraph", "chunk"))
    return rows.where(F.trim("chunk") != "").select(key, "paragraph", F.trim("chunk").alias("chunk"))


# Elements that are no text of their own, and those that open a section.
SKIPPED = {"Header", "Footer", "PageBreak", "Table"}
OPENING = {"Title", "ListItem"}


class Packer:
    """Elements of one document in order, packed into chunks of ``least`` to ``most`` characters.

    An opening element begins a section and is a parent chunk of its own, unless what is being packed is
    still short and takes it. Text is packed until the next piece would not fit, or elements are
    missing in between and the chunk is long enough; texts longer than a chunk are cut.
    """

    def __init__(self, most: int = 1000, least: int = 500):
        self.most, self.least = most, least
        self.out: list[dict] = []
        self.parts: list[str] = []
        self.size, self.start, self.end, self.section = 0, None, None, 0

    def fits(self, text: str) -> bool:
        return self.size + len(text) + bool(self.parts) <= self.most

    def emit(self, text: str, start, end, parent: bool) -> None:
        self.out.append({"content": text, "start": start, "end": end, "section": self.section, "is_parent": parent})

    def flush(self) -> None:
        if self.parts:
            self.emit("\n".join(self.parts), self.start, self.end, False)
        self.parts, self.size, self.start, self.end = [], 0, None, None

    def take(self, text: str, place) -> None:
        self.size += len(text) + bool(self.parts)
        self.start = place if not self.parts else self.start
        self.parts.append(text)
        self.end = place

    def add(self, kind: str | None, text: str | None, place: int | None) -> None:
        text = (text or "").strip()
        if kind in SKIPPED or not text:
            return
        short = 0 < self.size < self.least
        if kind in OPENING:
            if short and self.fits(text):
                self.take(text, place)
                self.section += 1
            else:
                self.flush()
                self.section += 1
                self.emit(text, place, place, True)
            return
        gap = self.parts and place is not None and self.end is not None and place != self.end + 1
        if gap and not (short and self.fits(text)):
            self.flush()
        while len(text) > self.most:
            room = self.most - self.size - bool(self.parts)
            if room <= 0:
                self.flush()
                continue
            self.take(text[:room], place)
            text = text[room:]
            self.flush()
        if text:
            if not self.fits(text):
                self.flush()
            self.take(text, place)

    def chunks(self) -> list[dict]:
        """All chunks, short ones merged with those after them in their section while they fit."""
        self.flush()
        out: list[dict] = []
        open_ = False  # whether the last chunk still takes others
        for c in self.out:
            last = out[-1] if out else None
            if open_ and not c["is_parent"] and c["section"] == last["section"] and len(last["content"]) + 1 + len(c["content"]) <= self.most:
                last["content"] += "\n" + c["content"]
                last["end"] = c["end"]
                continue
            out.append(dict(c))
            open_ = not c["is_parent"] and len(c["content"]) < self.least
        return out


def structure_chunks(elements: DataFrame, most: int = 1000, least: int = 500, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, content, start, end, section, is_parent) of elements (key, element, category, text).

    Elements are dealt by document and sorted, so that a worker packs one document after the other and
    holds no more than the one. Elements without a number come first.
    """
    kind = dict(elements.dtypes)[key]
    schema = f"{key} {kind}, chunk_index int, content string, start long, end long, section int, is_parent boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def shaped(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"start": "Int64", "end": "Int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        packer, now = None, None
        for frame in frames:
            for k, c, t, e in zip(frame[key], frame["category"], frame["text"], frame["element"]):
                if packer is None or k != now:
                    if packer is not None:
                        out += [{key: now, "chunk_index": i, **x} for i, x in enumerate(packer.chunks())]
                    packer, now = Packer(most, least), k
                packer.add(c, t, None if pd.isna(e) else int(e))
                if len(out) >= ROWS_A_TIME:
                    yield shaped(out)
                    out = []
        if packer is not None:
            out += [{key: now, "chunk_index": i, **x} for i, x in enumerate(packer.chunks())]
        yield shaped(out)

    rows = elements.where(F.col(key).isNotNull()).select(key, "element", "category", "text")
    return dealt(rows, key).sortWithinPartitions(key, "element").mapInPandas(run, schema)


# Chunks of small and of medium documents at most.
SMALL, MEDIUM = 5, 20


def size_category(n: Column) -> Column:
    return F.when(n <= SMALL, "small").when(n <= MEDIUM, "medium").otherwise("large")


def vector_plan(chunks: DataFrame, changed: DataFrame, key: str = "doc_id", at: str = "chunk_index", reach: int = 2) -> DataFrame:
    """(key, chunk, strategy): which chunks are embedded again after changes (key, chunk_index).

    All of small documents and of those without a known change; of medium ones the changed chunk and ``reach`` on
    either side; of large ones the changed chunk.
    """
    kinds = chunks.groupBy(key).agg(size_category(F.count("*")).alias("_kind"))
    news = changed.groupBy(key).agg(F.collect_set(at).alias("_at"))
    rows = chunks.select(key, at).join(kinds, key).join(news, key, "left")
    known = F.col("_at").isNotNull()
    strategy = F.when((F.col("_kind") == "small") | ~known, "full").when(F.col("_kind") == "medium", "contextual").otherwise("incremental")
    near = F.when(F.col("_kind") == "medium", reach).otherwise(0)
    hit = (strategy == "full") | F.exists("_at", lambda x: F.abs(x - F.col(at)) <= near)
    return rows.where(hit).select(key, at, strategy.alias("strategy"))
