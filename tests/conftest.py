from __future__ import annotations

import pytest

from promolift import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, "promolift-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
