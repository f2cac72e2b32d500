import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import build_session, shared_dir
    s = build_session("local[4]", 8)
    shared_dir(s)  # tests only: a scratch folder when the conf names none
    yield s
    s.stop()
