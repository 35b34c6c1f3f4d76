import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from panelforge.session import get_session, on_workers

    s = get_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    on_workers(s)
    yield s
    s.stop()
