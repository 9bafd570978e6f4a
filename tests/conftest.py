import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tideglass.session import local_session

    return local_session(4, 4)


@pytest.fixture
def rows():
    """A DataFrame's rows as a sorted list of plain tuples."""

    def plain(df, *columns):
        key = lambda r: tuple((v is None, str(v)) for v in r)
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)

    return plain
