import pytest

from reconspark.session import local


@pytest.fixture(scope="session")
def spark():
    return local("8", 8)
