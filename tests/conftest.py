"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("THREADSTONE_DRIVER_MEMORY", "3g")


@pytest.fixture(scope="session")
def spark():
    from threadstone.session import local_session

    s = local_session("4", shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
