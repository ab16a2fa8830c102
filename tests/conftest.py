import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from inkstone.session import local_session, ship

    session = ship(local_session(8))
    session.sparkContext.setLogLevel("ERROR")
    return session
