import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from turnloom.session import local_session

    return local_session(cores=4, shuffle_partitions=4, memory="3g")


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
