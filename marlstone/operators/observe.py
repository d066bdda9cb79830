"""Metrics, logs and events of a cluster: instant and range reads, rates, log searches, listings."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import logs
from marlstone.operators.series import asof_join

#: How old a sample may be to stand for a later time, in seconds.
LOOKBACK = 300


def instant(samples: DataFrame, at: str, *series: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """(series, value): the last sample at a time, not older than LOOKBACK."""
    t = F.lit(at).cast("timestamp_ntz")
    rows = samples.where((F.col(ts) <= t) & (F.col(ts) > t - F.expr(f"interval {LOOKBACK} seconds")))
    return rows.groupBy(*series).agg(F.max_by(value, ts).alias(value))


def query_range(samples: DataFrame, start: str, end: str, step: int, series: str, ts: str = "ts", value: str = "value", lookback: int = LOOKBACK) -> DataFrame:
    """(series, ts, value) on a grid of times: the last sample at or before each, if it is not too old; in pieces of a day, so a long series is many tasks."""
    grid = F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"interval {step} seconds"))).alias(ts)
    times = samples.select(series).distinct().select(series, grid)
    near = samples.where((F.col(ts) <= F.lit(end).cast("timestamp_ntz")) & (F.col(ts) >= F.lit(start).cast("timestamp_ntz") - F.expr(f"interval {lookback} seconds")))
    last = near.groupBy(series, ts).agg(F.max(F.struct(F.col(ts).alias("at"), F.col(value).alias("v"))).alias("_last"))
    found = asof_join(times, last, series, ts, "_last", "_s")
    fresh = F.col("_s.at") > F.col(ts) - F.expr(f"interval {lookback} seconds")
    return found.where(fresh).select(series, ts, F.col("_s.v").alias(value))


def rate(samples: DataFrame, window: str, seconds: int, *series: str, ts: str = "ts", value: str = "value", order: str | None = None) -> DataFrame:
    """(series, window_start, rate) of counters in tumbling windows: what they rose by, a fall being a reset to 0, a second."""
    at = Window.partitionBy(*series, "_w").orderBy(ts, *([order] if order else []))
    rows = samples.withColumn("_w", F.window(F.col(ts).cast("timestamp"), window)["start"])
    before = F.lag(value).over(at)
    rise = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    rows = rows.withColumn("_rise", rise)
    return rows.groupBy(*series, F.col("_w").cast("timestamp_ntz").alias("window_start")).agg((F.sum("_rise") / seconds).alias("rate"))


class MissingParameters(ValueError):
    """A template asks for parameters that are not given."""


def run_template(spark: SparkSession, templates: dict[str, str], name: str, context: dict) -> DataFrame:
    """A named SQL template with its parameters: {name} for identifiers, :name for values, which are bound and never pasted in."""
    if name not in templates:
        raise ValueError(f"no template {name}")
    sql = templates[name]
    wanted = [f for _, f, _, _ in string.Formatter().parse(sql) if f]
    bound = sorted(set(re.findall(r"(?<!:):([A-Za-z_]\w*)", sql)))
    missing = [p for p in [*wanted, *bound] if p not in context]
    if missing:
        raise MissingParameters(f"template {name} lacks {', '.join(missing)}")
    quoted = {p: "`" + str(context[p]).replace("`", "``") + "`" for p in wanted}
    return spark.sql(sql.format(**quoted), args={b: context[b] for b in bound})


def cache_key(path: Column, params: Column) -> Column:
    """A digest of a path and a map of parameters, whatever their order."""
    entries = F.array_sort(F.map_entries(params))
    return F.concat(F.lit("obs:metrics:"), F.sha2(F.concat(path, F.lit("?"), F.to_json(entries)).cast("binary"), 256))


def search_logs(rows: DataFrame, words: str, start: Column, end: Column, page: int = 1, size: int = 50, ts: str = "ts", message: str = "message", key: str = "id") -> DataFrame:
    """One page, the latest first, of messages with the words between two times; the words are marked."""
    hit = F.lower(message).contains(words.lower()) & F.col(ts).between(start, end)
    one = rows.where(hit).orderBy(F.desc(ts), key).offset((max(page, 1) - 1) * size).limit(size)
    return one.select(key, ts, logs.marked(F.col(message), words).alias(message))


def level_counts(rows: DataFrame, level: str = "level") -> DataFrame:
    """(level, n), also of a page: what has no level counts as unknown."""
    return rows.groupBy(F.coalesce(level, F.lit("unknown")).alias("level")).agg(F.count("*").alias("n"))


def flattened(streams: DataFrame, labels: str = "labels", values: str = "values") -> DataFrame:
    """(labels, at, message) of log streams, whose values are pairs of nanoseconds and a line."""
    rows = streams.select(labels, F.explode(values).alias("v"))
    return rows.select(labels, F.timestamp_micros(F.expr("try_cast(element_at(v, 1) as bigint) div 1000")).alias("at"), F.element_at("v", 2).alias("message"))


def listing(rows: DataFrame, asked: dict, ts: str = "created_at", start: Column | None = None, end: Column | None = None, key: str = "id", most: int = 100) -> DataFrame:
    """The latest rows that agree with what is asked (values that are None are not) between two times, 1000 at most."""
    for name, value in asked.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    rows = rows if start is None else rows.where(F.col(ts) >= start)
    rows = rows if end is None else rows.where(F.col(ts) <= end)
    return rows.orderBy(F.desc(ts), key).limit(min(max(most, 1), 1000))


def normalized_results(rows: DataFrame, most: int = 10, order: str = "rank") -> DataFrame:
    """(title, url, snippet, source) of found pages that have a URL: titles and sources default to it and to its host."""
    host = F.try_parse_url("url", F.lit("HOST"))
    kept = rows.where(F.coalesce("url", F.lit("")) != "").orderBy(order).limit(most)
    filled = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    return kept.select(filled(F.col("title"), F.col("url")).alias("title"), "url", filled(F.col("content"), F.col("summary")).alias("snippet"), filled(F.col("source"), host).alias("source"))
