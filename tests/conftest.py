import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from waypoint.session import build_session
    from waypoint.sources.tables import utc

    s = utc(build_session("local[4]", partitions=4, name="tests"))
    yield s
    s.stop()
