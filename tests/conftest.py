import pytest

from rastrum.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
