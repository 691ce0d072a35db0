import pytest

from logloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(cpus=4, memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()
