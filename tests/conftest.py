import pytest

from paperfold.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()
