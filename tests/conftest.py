"""One local Spark session for all tests."""

import pytest

from lexmill.session import expose_package, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    expose_package(session)
    return session
