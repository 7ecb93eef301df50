import pytest

from routescope.session import local_session, ship_code


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cpus=4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    ship_code(session)
    yield session
    session.stop()
