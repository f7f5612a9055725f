import pytest

from cyclecast import session


@pytest.fixture(scope="session")
def spark():
    found = session.build_session("tests", 8, **{"spark__sql__shuffle__partitions": "8"})
    session.workers_see_package(found)
    yield found
    found.stop()
