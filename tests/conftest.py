import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import build_session
    s = build_session("4", "tests", partitions=4)
    yield s
    s.stop()
