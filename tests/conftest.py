import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from geotrail.session import local_session

    s = local_session(8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
