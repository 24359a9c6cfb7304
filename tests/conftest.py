import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tapeworks.session import build_session

    session = build_session("tests", 8, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return session
