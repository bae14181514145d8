import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowlens.session import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    running = session("tests", cores=4)
    running.sparkContext.setLogLevel("ERROR")
    yield running


@pytest.fixture(scope="session")
def sf_dir():
    return SF
