"""Watch streams by resource: versions that come late or again change nothing, silent resources are told, deleted ones are forgotten.

The state of a resource is its last version and what it was then; events are taken one at a time, so a busy
resource needs no more memory than a quiet one. State is in the state store of the checkpoint, from which a
stream that was stopped goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "uid string, version long, change string, state string"


def with_state_store(spark: SparkSession) -> None:
    """States of several columns and timers need the RocksDB store, which is set where the session has Spark's default."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


class Resource(StatefulProcessor):
    """What a resource's event changes; timers by event time tell of silence and end the memory of deleted ones."""

    def __init__(self, silent_ms: int | None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version long, state string, gone boolean, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, state, gone, due = self.last.get() if self.last.exists() else (None, None, True, None)
        before = due
        for frame in rows:
            out = []
            for v, kind, s, ts in zip(frame["version"], frame["kind"], frame["state"], frame["ts"]):
                if pd.isna(v) or (version is not None and v <= version):
                    continue  # late or repeated
                s = None if pd.isna(s) else s
                if kind == "BOOKMARK":
                    change = None
                elif kind == "DELETED":
                    change, gone = None if gone else "deleted", True
                else:
                    change, gone = "created" if gone else "updated" if s != state else None, False
                    state = s
                version = int(v)
                if self.silent_ms is not None and not pd.isna(ts):
                    due = max(due or 0, int(pd.Timestamp(ts).value // 1_000_000) + self.silent_ms)
                if change:
                    out.append((key[0], version, change, s))
            if out:
                yield pd.DataFrame(out, columns=["uid", "version", "change", "state"])
        if version is not None:
            self.last.update((version, state, gone, due))
        if due is not None and due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, state, gone, due = self.last.get()
        if gone:
            self.last.clear()
        else:
            self.last.update((version, state, gone, None))
            yield pd.DataFrame([(key[0], version, "silent", state)], columns=["uid", "version", "change", "state"])

    def close(self) -> None:
        pass


def watch_changes(events: DataFrame, silent_seconds: float | None = None, late: str = "0 seconds") -> DataFrame:
    """(uid, version, change, state) of a stream of events (uid, version, kind, state, ts).

    Kinds are ADDED, MODIFIED, DELETED and BOOKMARK, which only moves the version. An event whose version
    is not above the last one of its resource changes nothing. With ``silent_seconds`` a resource without events for so long, by
    event time, is told once, and a deleted one forgotten; an older event that comes after that counts as new.
    """
    with_state_store(events.sparkSession)
    rows = events.select(F.col("uid").cast("string").alias("uid"), F.col("version").cast("long").alias("version"), "kind", F.col("state").cast("string").alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", late) if silent_seconds is not None else rows
    processor = Resource(None if silent_seconds is None else int(silent_seconds * 1000))
    return rows.groupBy("uid").transformWithStateInPandas(processor, CHANGES, "Append", "None" if silent_seconds is None else "EventTime")


def versions_applied(events: DataFrame) -> DataFrame:
    """The same in batch, for events that come in order of ``arrived``: those above all versions before them, and what they change."""
    order = Window.partitionBy("uid").orderBy("arrived")
    seen = F.max("version").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("_seen", seen).where("version is not null and (_seen is null or version > _seen)")
    kept = rows.where("kind != 'BOOKMARK'")
    gone = F.coalesce(F.lag("kind").over(order) == "DELETED", F.lit(True))
    # the state that was there before a deletion is not compared with
    change = F.when(F.col("kind") == "DELETED", F.when(~gone, "deleted")).when(gone, "created").when(~F.col("state").eqNullSafe(F.lag("state").over(order)), "updated")
    return kept.withColumn("change", change).where("change is not null").select("uid", "version", "change", "state")
