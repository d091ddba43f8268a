from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from routeloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_limits(monkeypatch):
    """Limits low enough for tiny tables to take the paths meant for hot keys and hubs."""
    from routeloom import skew
    from routeloom.operators import network

    monkeypatch.setattr(skew, "HOT_ROWS", 4)
    monkeypatch.setattr(network, "SLOT_EDGES", 3)
