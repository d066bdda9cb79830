"""Series in pieces: what a window over a key's whole history gives, with no task that holds more than one piece.

Rows are dealt by key and time bucket. A first pass keeps one row of each piece, its last; these few
are put in order by key, so that each piece knows what stands at its start. A second pass goes over the pieces
alone. So a series of any length is as many tasks as it has buckets, and results are those of one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a piece.
PIECE = 86_400


def bucket(ts: Column, seconds: float = PIECE) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000))


def _starts(lasts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, _b, ``value``) of pieces (key, _b, _last): the last of the nearest earlier piece that has one, for the pieces after it."""
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return lasts.select(key, "_b", F.last("_last", ignorenulls=True).over(before).alias(value))


def _with_starts(rows: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    named = starts.withColumnsRenamed({key: "_key", "_b": "_piece"})
    return rows.join(named, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_piece")), "left").drop("_key", "_piece")


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str, seconds: float = PIECE) -> DataFrame:
    """Each left row with the last right value at or before its time, as ``relational.asof_join`` gives; of right rows at one time the largest value counts.

    Rows whose key or time is null find nothing; left columns are kept.
    """
    rows = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias(out), F.lit(1).alias("_side"))
    others = right.select(key, ts, F.col(value).alias(out), F.lit(0).alias("_side"))
    both = rows.unionByName(others, allowMissingColumns=True).withColumn("_b", bucket(F.col(ts), seconds))
    lasts = both.groupBy(key, "_b").agg(F.max_by(F.when(F.col("_side") == 0, F.struct(F.col(out).alias("v"))), F.when((F.col("_side") == 0) & F.col(out).isNotNull(), F.struct(ts, out))).alias("_last"))
    w = Window.partitionBy(key, "_b").orderBy(F.col(ts), "_side", F.col(out)).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(out, F.last(out, ignorenulls=True).over(w)).where("_side = 1")
    found = _with_starts(filled, _starts(lasts, key, "_start"), key)
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    return found.withColumn(out, F.when(known, F.coalesce(out, F.col("_start.v")))).drop("_side", "_b", "_start")


def with_previous(rows: DataFrame, key: str, ts: str, order: list[str], columns: dict[str, str], seconds: float = PIECE) -> DataFrame:
    """``rows`` with, for each of ``columns`` (its new name: column), that of the row before of the same key, null for the first.

    Rows of a key are in order of ``ts``, then ``order``; all rows of one time are in one piece.
    """
    rows = rows.withColumn("_b", bucket(F.col(ts), seconds))
    own = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    lasts = rows.groupBy(key, "_b").agg(F.max_by(own, F.struct(ts, *order)).alias("_last"))
    w = Window.partitionBy(key, "_b").orderBy(ts, *order)
    rows = rows.withColumn("_before", F.lag(own).over(w))
    rows = _with_starts(rows, _starts(lasts, key, "_start"), key)
    before = F.coalesce("_before", "_start")
    return rows.select("*", *[before.getField(n).alias(n) for n in columns]).drop("_b", "_before", "_start")


def changes(events: DataFrame, key: str, ts: str, order: str, kind: str, state: str, seconds: float = PIECE) -> DataFrame:
    """Change capture as ``streaming.events.changes``: created, updated or deleted for each event that changes the state of its key."""
    rows = with_previous(events, key, ts, [order], {"_k": kind, "_s": state}, seconds)
    gone = F.col("_k").isNull() | (F.col("_k") == "DELETED")
    change = F.when(F.col(kind) == "DELETED", F.when(~gone, "deleted")).when(gone, "created").when(~F.col(state).eqNullSafe(F.col("_s")), "updated")
    return rows.withColumn("change", change).where(F.col("change").isNotNull()).drop("_k", "_s")


def sessions(events: DataFrame, ts: str, gap: float, key: str, seconds: float = PIECE) -> DataFrame:
    """(key, session_start, session_end, n): runs of events of a key less than ``gap`` seconds apart; the end is that of the last event.

    Runs are counted in each piece; those that reach over its end are put together from one row a run.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = events.where(F.col(ts).isNotNull()).select(key, F.col(ts).alias("_t"), bucket(F.col(ts), seconds).alias("_b"))
    in_piece = Window.partitionBy(key, "_b").orderBy("_t")
    far = lambda now, before: F.coalesce(now - before >= gap * 1_000_000, F.lit(True)).cast("int")
    rows = rows.withColumn("_new", far(micros("_t"), F.unix_micros(F.lag("_t").over(in_piece).cast("timestamp"))))
    rows = rows.withColumn("_run", F.sum("_new").over(in_piece.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(key, "_b", "_run").agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count("*").alias("n"))
    # only the first and last runs of a piece can go on beyond it
    ends = runs.groupBy(key, "_b").agg(F.max("_run").alias("_most"))
    runs = runs.join(ends.withColumnsRenamed({key: "_key", "_b": "_piece"}), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_piece"))).drop("_key", "_piece")
    inner = runs.where("_run > 1 and _run < _most").select(key, "_from", "_to", "n")
    outer = runs.where("_run = 1 or _run = _most")
    order = Window.partitionBy(key).orderBy("_from")
    outer = outer.withColumn("_new", far(micros("_from"), F.unix_micros(F.lag("_to").over(order).cast("timestamp"))))
    outer = outer.withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    outer = outer.groupBy(key, "_s").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("n").alias("n")).drop("_s")
    return inner.unionByName(outer).select(key, F.col("_from").alias("session_start"), F.col("_to").alias("session_end"), "n")
