import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kvstrata.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, **{"spark.checkpoint.dir": str(shared), "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(shared / "warehouse")})
    session.sparkContext.setCheckpointDir(str(shared))
    yield session
    session.stop()
