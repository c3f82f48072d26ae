import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tallygrid.session import local_session
    return local_session("4", 4)


@pytest.fixture
def rows():
    """Sorted plain tuples of a frame."""
    def get(df, *cols):
        out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
        return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))
    return get
