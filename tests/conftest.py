import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from turnweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_bins(monkeypatch):
    """Bins of a few rows, so that every ordered operator has to carry values across bins."""
    from turnweave.operators import intervals, running

    monkeypatch.setattr(running, "POSITION_BIN", 3)
    monkeypatch.setattr(intervals, "TIME_BIN_SECONDS", 7)
    monkeypatch.setattr(intervals, "JOIN_BIN_SECONDS", 4)
