import pytest

from voltlake import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
