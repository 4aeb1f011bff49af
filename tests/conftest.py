import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("LAKELOOM_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from lakeloom.plans.session import session

    s = session("tests", partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return f"{DATA}/sf0.01"
