import pytest

from leasegrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="leasegrid-tests")
    yield s
