import pytest

from pairlens.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cores="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
