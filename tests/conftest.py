from __future__ import annotations

import pytest

from chunkloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"
