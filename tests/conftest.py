import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from auditloom.session import get_spark

    folder = tmp_path_factory.mktemp("spark")
    session = get_spark(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__checkpoint__dir=f"file://{folder}/checkpoints", spark__sql__warehouse__dir=f"{folder}/warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
