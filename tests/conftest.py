import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marlstone.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", 8, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(shared / "warehouse")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
