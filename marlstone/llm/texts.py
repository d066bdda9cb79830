"""Words, word hashes and Arrow batches shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D. bytes.split() has the same set.
SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8, null has none; ``lower`` turns A-Z, and no other letters, to lower case."""
    raw = text.encode("utf-8", "replace") if text else b""
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most ``most`` words at a time."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S31, _S29 = np.uint64(31), np.uint64(29)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = (h ^ (h >> _S29)) * _B
    return (h ^ (h >> _S31)) * _A


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each window of k words, in text order; with fewer words one for all of them."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out + hashes[i : n - width + 1 + i])
    return out


def filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Bytes that a worker takes on at a time (one row at least), as a batch holds rows of any length.
SLICE_BYTES = 4_000_000


def sliced(batches: Iterator, size: int = SLICE_BYTES) -> Iterator:
    """Arrow batches or arrays in slices of about so many bytes, without empty ones."""
    for batch in batches:
        n = len(batch)
        rows = max(1, int(n * size / max(1, batch.nbytes)))
        for at in range(0, n, rows):
            yield batch.slice(at, rows)


#: Bytes of an Arrow batch between the JVM and a worker; by rows alone a batch of long texts is large on both sides.
BATCH_BYTES = 8_000_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_BYTES where the session has Spark's own bound of 64 MB."""
    if spark.conf.get(_BATCH_SETTING) == "67108864b":
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return what a task has freed to the system, as Spark keeps a worker for the next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with per-task state: ``make()`` runs once in a task and its result on each slice of a batch."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        step, arrow = make(), to_arrow_schema(fields)
        for batch in sliced(batches, slice_bytes):
            got = step(batch)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)
        step = got = batch = None
        give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, fields)


def constant(values, kind: str) -> Column:
    """An array literal from one string, which is folded when the plan is made: cheap at any length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column, block: int = 256) -> Column:
    """``merge`` of ``zero`` and the values before each value of an array of long.

    In blocks, so that the arrays that grow stay short: n * block + (n / block) ** 2 copies, not n ** 2.
    """

    def short(v: Column, first: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), first.alias("now"))
        step = lambda a, x: F.struct(F.concat(a["out"], F.array(a["now"])).alias("out"), merge(a["now"], x).alias("now"))
        return F.aggregate(v, start, step)["out"]

    def blocks(v: Column) -> Column:
        many = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / block).cast("int") - 1, F.lit(0)))
        return F.transform(many, lambda i: F.slice(v, i * block + 1, block))

    def of_blocks(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, zero, merge))
        return let(short(whole, zero), lambda firsts: F.flatten(F.transform(parts, lambda p, i: short(p, F.element_at(firsts, i + 1)))))

    return let(values, lambda v: let(blocks(v), of_blocks))


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of the values before each value of an array of long."""
    return running(values, lambda a, x: a + x, F.lit(0).cast("long"), block)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; never true for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
