import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SHUFFLE_PARTITIONS", "4")
    from banfleet.session import local_session

    session = local_session("tests", 4, "4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="banfleet-test-")


@pytest.fixture(scope="session")
def rows():
    def collect(df, *columns):
        """Rows as sorted tuples, NULLs first."""
        picked = [tuple(r) for r in df.select(*columns or df.columns).collect()]
        return sorted(picked, key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))

    return collect
