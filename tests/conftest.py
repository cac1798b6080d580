"""One small local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from plexgraph.session import session

    s = session(master=f"local[{os.environ.get('TEST_CPUS', '4')}]", partitions=4, spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
