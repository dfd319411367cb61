import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lingualake.session import build

    shared = tmp_path_factory.mktemp("shared")
    s = build(
        "tests",
        "local[4]",
        **{
            "spark__sql__shuffle__partitions": "3",
            "spark__ui__enabled": "false",
            "spark__driver__memory": "3g",
            "spark__checkpoint__dir": f"file://{shared}",
            "spark__ui__showConsoleProgress": "false",
            "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
