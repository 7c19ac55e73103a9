import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from parchmint.session import local_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session(4, "4g", "tests"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
