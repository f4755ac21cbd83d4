import pytest

from tidemark.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[8]", 4, spark__driver__memory="6g")
    s.sparkContext.setLogLevel("OFF")
    yield s


@pytest.fixture
def rows():
    """The rows of a DataFrame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
