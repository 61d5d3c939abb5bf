import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tellurion.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "8"), 4, **{"spark.sql.streaming.metricsEnabled": "false"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
