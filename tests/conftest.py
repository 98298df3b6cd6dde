import pytest

from lodeworks.runtime import session


@pytest.fixture(scope="session")
def spark():
    found = session(cores=4, partitions=4, memory="4g")
    found.sparkContext.setLogLevel("ERROR")
    yield found
