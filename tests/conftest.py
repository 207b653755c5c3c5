import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from roadpoints.session import local_session
    s = local_session(8, "8g", "roadpoints-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
