import pytest

from logquarry.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session(4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
