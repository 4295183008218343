import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lastseen import build_session  # noqa: E402

SF_DIRS = {
    "small": "/root/testdata/sf0.001",
    "medium": "/root/testdata/sf0.01",
    "large": "/root/testdata/sf0.1",
}


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "lastseen-tests",
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
