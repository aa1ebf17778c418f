import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from rxloom.session import local_session

    os.environ.setdefault("RXLOOM_DRIVER_MEMORY", "3g")
    s = local_session(4, 4, "tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
