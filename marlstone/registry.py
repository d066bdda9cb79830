"""Where queries and their SQL are registered, and the tables they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import read_table, register_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
W = r"[\p{L}\p{N}_]+"
TOKENS = rf"regexp_extract_all(lower(text), '{W}')"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB's SQL for the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def both(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """A query that SQL says the same way for both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_tables(spark, sf_dir, tables.split())
        return spark.sql(sql)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle or sql


def _t(name):
    return lambda spark, d: read_table(spark, d, name)


docs, vectors, events, pages, turns = map(_t, ("documents", "embeddings", "events", "pages", "conversations"))
nation, region, customer, supplier, part, orders, lineitem, benchmark = map(_t, ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "benchmark"))
