"""The entry, with and without the training-data part, and the shared folder."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.operators import relational, search
from marlstone.plans import stash

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", ["duckdb", "xxhash", "regex", "zstandard"])
def test_the_entry_works_without_a_package(name):
    code = f"import sys; sys.modules['{name}'] = None; import __spark_entry__ as e; q = e.queries(); assert 'kw_search_topk' in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 250


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stash.shared_dir(Session())


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(500).selectExpr("id", "id % 7 as a", "cast(null as string) as none").repartition(5)
    got = relational.numbered(rows, F.col("a").desc(), "id").collect()
    want = sorted(((-x.a, x.id) for x in got))
    assert [(-x.a, x.id) for x in sorted(got, key=lambda x: x.n)] == want and sorted(x.n for x in got) == list(range(1, 501))
    assert relational.numbered(rows.limit(0), "id").count() == 0


def test_all_ranks_count(spark):
    left = spark.range(40).selectExpr("id", "cast(id as double) as score")
    right = spark.range(40).selectExpr("id", "cast(-id as double) as score")
    want = {i: 1 / (60 + 40 - i) + 1 / (61 + i) for i in range(40)}
    got = {x.id: x.score for x in search.fuse(left, right, "id", "rrf", most=None).collect()}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)
    few = {x.id: x.score for x in search.fuse(left, right, "id", "rrf", most=5).collect()}
    assert len(few) == 10
