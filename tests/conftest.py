from __future__ import annotations

import pytest

from notewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
