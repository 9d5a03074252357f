import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from lexforge import get_session
    s = get_session("local[4]", app="lexforge-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="lexforge-test-", dir="/tmp")


SF_SMALL = "/root/testdata/sf0.001"
