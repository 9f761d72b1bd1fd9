import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# Python workers find the package by this
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from lorekeep.session import local_session

    session = local_session(4, "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
