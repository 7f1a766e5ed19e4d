import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillgraph.runtime import build_session

    s = build_session(4, "6g", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
