import pytest

from peakloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
