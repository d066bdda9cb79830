"""Event streams: windows, sessions, deduplication, change capture. Each works on batch frames, too."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.plans.stash import Stash, shared_dir


def as_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", pattern).parquet(folder)


def with_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as TIMESTAMP: watermarks don't take TIMESTAMP_NTZ."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = with_time(events, ts)
    rows = rows.withWatermark(ts, late) if late else rows
    out = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n", "total")


def hopping(events: DataFrame, ts: str, width: str, slide: str, *keys: str) -> DataFrame:
    out = with_time(events, ts).groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    out = with_time(events, ts).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def over_limit(events: DataFrame, ts: str, key: str, width: str, limit: int) -> DataFrame:
    """Windows of a key with more than ``limit`` events."""
    return tumbling(events, ts, width, key).where(F.col("n") > limit).select("window_start", key, "n")


def changes(events: DataFrame, key: str, ts: str, order: str, kind: str, state: str) -> DataFrame:
    """Change capture in batch: created, updated or deleted for each event that changes the state of its key."""
    w = Window.partitionBy(key).orderBy(ts, order)
    rows = events.withColumn("_k", F.lag(kind).over(w)).withColumn("_s", F.lag(state).over(w))
    gone = F.col("_k").isNull() | (F.col("_k") == "DELETED")
    change = F.when(F.col(kind) == "DELETED", F.when(~gone, "deleted")).when(gone, "created").when(~F.col(state).eqNullSafe(F.col("_s")), "updated")
    return rows.withColumn("change", change).where(F.col("change").isNotNull()).drop("_k", "_s")


def stream_changes(events: DataFrame, key: str, kind: str, state: str, ts: str | None = None) -> DataFrame:
    """The same on a stream: the last state of a key is kept and compared with its events.

    Events of one micro-batch are taken in order of ``ts``, those of later ones after them, as they arrive.
    """

    def step(names: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        alive, last = kept.get if kept.exists else (False, None)
        rows = pd.concat(list(batches), ignore_index=True)  # one key's events of one micro-batch
        if ts is not None:
            rows = rows.sort_values(ts, kind="stable")
        out = []
        for k, s in zip(rows[kind], rows[state]):
            if k == "DELETED":
                change = "deleted" if alive else None
                alive = False
            else:
                change = "created" if not alive else "updated" if s != last else None
                alive, last = True, s
            if change:
                out.append((names[0], change, s))
        kept.update((alive, last))
        yield pd.DataFrame(out, columns=[key, "change", state])

    k, s = dict(events.dtypes)[key], dict(events.dtypes)[state]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {k}, change string, {state} {s}", f"alive boolean, last {s}", "append", "NoTimeout")


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a stream through what there is and return the table that it filled, with its state in the shared folder.

    For small results, such as counts: the table is in the driver's memory. ``run_to_table`` is for others.
    """
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    # a memory table can't be taken up again, so each run has a checkpoint of its own
    query.option("checkpointLocation", f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}").start().awaitTermination()
    return spark.table(name)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drive an appending stream through what there is, into files of the shared folder, and return what they hold; of any size."""
    spark = stream.sparkSession
    root = Stash(spark).root
    to_files(stream, f"{root}/{name}", f"{root}/{name}-checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/{name}")


def to_files(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Append a stream to Parquet, exactly once by its checkpoint; ``every`` such as "300 seconds", or once through what there is."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def reconciled(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch with its number to ``merge``, which has to give the same result when one comes again."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def renewed_limit(events: DataFrame, ts: str, key: str, seconds: int, limit: int) -> DataFrame:
    """Sessions of a key with more than ``limit`` events, where every event puts off the end by so many seconds."""
    return sessions(events, ts, f"{seconds} seconds", key).where(F.col("n") > limit)


def sync_plan(states: DataFrame, now: Column, interval: int, forced: Column | None = None) -> DataFrame:
    """``states`` (resource_version, updated_at) with ``mode``: incremental within a third of the interval, 300 s at most, of the last sync, else full."""
    window = min(300.0, interval / 3)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 1e6
    fresh = F.col("resource_version").isNotNull() & (age < window) & ~(forced if forced is not None else F.lit(False))
    return states.withColumn("mode", F.when(F.coalesce(fresh, F.lit(False)), "incremental").otherwise("full"))


def absent(snapshots: DataFrame, seen: DataFrame, *scope: str, key: str = "uid") -> DataFrame:
    """Live snapshots (scope, uid, is_deleted) of listed scopes whose uid the listing has not: those to be marked as gone."""
    listed = seen.select(*scope).distinct()
    return snapshots.where(~F.col("is_deleted")).join(listed, list(scope), "left_semi").join(seen.select(*scope, key).distinct(), [*scope, key], "left_anti")


def field_changes(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """A map of the fields that differ to their values before and after; two nulls don't differ."""
    text = lambda c: c.cast("string")
    entries = [F.when(~before[f].eqNullSafe(after[f]), F.struct(F.lit(f).alias("key"), F.struct(text(before[f]).alias("before"), text(after[f]).alias("after")).alias("value"))) for f in before]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def retained(rows: DataFrame, ts: str, now: str, days: int) -> DataFrame:
    return rows.where(F.col(ts) >= F.expr(f"timestamp_ntz'{now}' - interval {days} days"))


def first_seen(events: DataFrame, *keys: str, ts: str, late: str) -> DataFrame:
    """Duplicates within the watermark go."""
    return with_time(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
