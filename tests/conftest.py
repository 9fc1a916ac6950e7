import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from provenant.session import get_session

    s = get_session("local[8]", "tests", **{"spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false", "spark__driver__memory": "4g", "spark__checkpoint__dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark__ui__showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
