import pytest

from larder.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffles=4)
