import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session, ship_package

    session = local_session("8", 4)
    ship_package(session)
    yield session
    session.stop()
