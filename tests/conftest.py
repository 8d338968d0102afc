import os

import pytest

from viewmart.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=os.environ.get("TEST_CPUS", "8"), shuffle_partitions=4, memory="4g")
    yield session
    session.stop()
