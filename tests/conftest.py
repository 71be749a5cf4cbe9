import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from evidentia.session import local_session

    return local_session(cores=8, partitions=4)


DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"
