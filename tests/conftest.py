import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from concord.session import local_session

    session = local_session("8", "tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
