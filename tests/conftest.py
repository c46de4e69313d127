import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from blockfold.session import session

    folder = tmp_path_factory.mktemp("checkpoints")
    s = session("local[4]", 4, "tests", spark__checkpoint__dir=f"file://{folder}", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
