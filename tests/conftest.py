import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from deskmill.session import apply_conf, build_session
    session = build_session("tests", master="local[8]", partitions=8, memory="6g")
    apply_conf(session)
    yield session
    session.stop()
