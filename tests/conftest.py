import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ratelens.session import local_session

    session = local_session(8, memory="6g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return TABLES
