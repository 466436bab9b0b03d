import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("GAUGEWORKS_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from gaugeworks.runtime import local_session

    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
