import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from lexilink.session import build_session

    session = build_session("local[4]", 4, spark__sql__files__maxPartitionBytes="8m")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
