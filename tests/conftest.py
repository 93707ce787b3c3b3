import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from gaugeline.session import build_session

    session = build_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
