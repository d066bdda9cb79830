"""Every query with an oracle against DuckDB on the smallest tables; the rest must give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone import queries
from marlstone.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{round(float(v), 3) + 0.0:.3f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    out = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in out.collect()]
    if name not in queries.ORACLES:
        assert out.columns
        return
    want = duck.sql(queries.ORACLES[name])
    names = sorted(out.columns)
    assert names == sorted(want.columns)
    mine = sorted(tuple(plain(r[out.columns.index(c)]) for c in names) for r in rows)
    theirs = sorted(tuple(plain(r[want.columns.index(c)]) for c in names) for r in want.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
