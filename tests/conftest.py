import pytest

from termtide.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores=4, memory="4g")


@pytest.fixture
def rows():
    """Collect a DataFrame as a sorted list of tuples."""
    def collect(df, *columns):
        return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())
    return collect
