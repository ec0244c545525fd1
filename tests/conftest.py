import pytest

from millrace.storage import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", 4, spark__sql__shuffle__partitions="2", spark__driver__memory="4g")
