import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidewheel.session import build_session

    session = build_session("local[8]", "tests", 4, "8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
