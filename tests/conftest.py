import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gleaner.runtime import prepare, session

    s = prepare(session("tests", cores="4", partitions=4))
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('checkpoints')}")
    yield s


SMALL = "/root/testdata/sf0.001"
