import pytest

from poledger import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("poledger-tests", master="local[4]", partitions=4)
    yield s
    s.stop()
