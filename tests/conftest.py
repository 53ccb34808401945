from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyspark.session import drop_staged, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", partitions=4)
    yield session
    drop_staged(session)
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as sorted tuples of text, for order-free comparison."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted(tuple(None if v is None else str(v) for v in r) for r in picked.collect())

    return collect
