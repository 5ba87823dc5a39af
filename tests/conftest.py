import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from worktally.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples, missing last."""

    def collect(df, *cols):
        df = df.select(*[f"`{c}`" for c in cols]) if cols else df
        return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, str(type(v)), v) for v in r])

    return collect
