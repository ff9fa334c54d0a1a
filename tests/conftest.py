import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import build_session

    s = build_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
