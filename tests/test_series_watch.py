"""Series in pieces against one window, and watch streams against the batch query and plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import relational, series
from marlstone.streaming import events as S
from marlstone.streaming import watch

START = datetime(2024, 1, 1)


def history(seed, n=400):
    r = random.Random(seed)
    return [(i, r.choice(["a", "a", "a", "b", None]), START + timedelta(seconds=r.randrange(0, 200_000, 50)), r.choice(["x", "y", "z", None]), r.choice(["MODIFIED", "ADDED", "DELETED"])) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(history(1), "id long, key string, ts timestamp_ntz, state string, kind string").repartition(4)


@pytest.mark.parametrize("seconds", [600, 86_400, 10_000_000])
def test_pieces_give_what_one_window_gives(rows, seconds):
    plain = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
    left, right = rows.where("id % 3 = 0").select("id", "key", "ts"), rows.where("id % 3 = 1 and key is not null")
    right = right.groupBy("key", "ts").agg(F.max("id").alias("found"))
    want = relational.asof_join(left.where("key is not null"), right, "key", "ts", "found", "got")
    got = series.asof_join(left, rows.where("id % 3 = 1").select("key", "ts", F.col("id").alias("found")), "key", "ts", "found", "got", seconds)
    assert plain(got.where("key is not null").select("id", "got")) == plain(want.select("id", "got"))
    assert got.where("key is null and got is not null").count() == 0 and got.count() == left.count()
    assert plain(series.changes(rows, "key", "ts", "id", "kind", "state", seconds).select("id", "change")) == plain(S.changes(rows, "key", "ts", "id", "kind", "state").select("id", "change"))
    runs, now = [], {}
    for key, ts in sorted(((k or "", t) for _, k, t, _, _ in history(1))):
        if key not in now or (ts - now[key][2]).total_seconds() >= 700:
            now[key] = [key, ts, ts, 0]
            runs.append(now[key])
        now[key][2], now[key][3] = ts, now[key][3] + 1
    assert plain(series.sessions(rows, "ts", 700, "key", seconds).fillna("", "key")) == sorted(map(tuple, runs), key=repr)


def test_no_piece_of_a_long_series_is_large(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("key"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.col("id").alias("v"))
    assert rows.groupBy("key", series.bucket(F.col("ts")).alias("b")).count().agg(F.max("count")).first()[0] == 1440
    found = series.with_previous(rows, "key", "ts", [], {"before": "v"})
    assert found.where("not (before <=> case when v > 0 then v - 1 end)").count() == 0


def feed():
    r = random.Random(4)
    out = []
    for i in range(300):
        uid = f"r{r.randrange(6)}"
        out.append((uid, i // 3 - r.choice([0, 0, 0, 1, 5]), r.choice(["ADDED", "MODIFIED", "MODIFIED", "DELETED", "BOOKMARK"]), r.choice(["x", "y", None]), START + timedelta(seconds=10 * i), i))
    return out


def plain_changes(rows):
    last, out = {}, []
    for uid, version, kind, state, _, _ in rows:
        seen, was, gone = last.get(uid, (None, None, True))
        if seen is not None and version <= seen:
            continue
        change = None
        if kind == "DELETED":
            change, gone = None if gone else "deleted", True
        elif kind != "BOOKMARK":
            change, gone, was = ("created" if gone else "updated" if state != was else None), False, state
        last[uid] = (version, was, gone)
        if change:
            out.append((uid, version, change, state))
    return sorted(out, key=repr)


SCHEMA = "uid string, version long, kind string, state string, ts timestamp_ntz, arrived long"


def test_versions_in_batch(spark):
    got = watch.versions_applied(spark.createDataFrame(feed(), SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_changes(feed())


def test_watch_stream_goes_on_after_a_restart(spark, tmp_path):
    rows, source = feed(), tmp_path / "in"
    for k in range(6):
        part = spark.createDataFrame(rows[k * 50 : (k + 1) * 50], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(source / f"{k}"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for upto in (3, 6):  # stopped after three files, then taken up again with the others; each file is a batch, and some come again
        folder = tmp_path / "now"
        folder.mkdir(exist_ok=True)
        for k in range(upto - 3, upto):
            for f in (source / f"{k}").glob("*.parquet"):
                (folder / f"{k}.parquet").write_bytes(f.read_bytes())
                stream = S.as_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema)
                S.to_files(watch.watch_changes(stream), out, checkpoint).awaitTermination()
    got = sorted((tuple(x) for x in spark.read.parquet(out).collect()), key=repr)
    assert got == plain_changes(rows)


def test_silent_resources_are_told_once(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[("a", 1, "ADDED", "x", at(0), 0), ("b", 1, "ADDED", "x", at(0), 1), ("c", 1, "ADDED", "x", at(0), 2), ("c", 2, "DELETED", None, at(5), 3)], [("b", 2, "MODIFIED", "y", at(50), 4)], [("d", 1, "ADDED", "z", at(200), 5)], [("d", 2, "MODIFIED", "z", at(210), 6)]]
    folder = tmp_path / "in"
    folder.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        for f in (tmp_path / f"b{k}").glob("*.parquet"):
            (folder / f"{k}.parquet").write_bytes(f.read_bytes())
        stream = S.as_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema)
        S.to_files(watch.watch_changes(stream, silent_seconds=60), out, checkpoint).awaitTermination()
    got = sorted(((x.uid, x.change) for x in spark.read.parquet(out).collect()))
    assert got == [("a", "created"), ("a", "silent"), ("b", "created"), ("b", "silent"), ("b", "updated"), ("c", "created"), ("c", "deleted"), ("d", "created")]
