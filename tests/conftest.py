import pytest

from quern.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    session = build_session("tests", "local[4]", **{"spark__ui__enabled": "false", "spark__checkpoint__dir": f"file://{folder}", "spark__driver__memory": "4g", "spark__sql__shuffle__partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
