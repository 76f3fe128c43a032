import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftwork.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("siftwork-tests", master="local[4]", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("SIFTWORK_TEST_SF", "/root/testdata/sf0.001")
