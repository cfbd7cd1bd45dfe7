import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session_ = session("4")
    yield session_
    session_.stop()
