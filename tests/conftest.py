import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mailroom.session import build_session
    s = build_session("local[*]", shuffle_partitions=8, app="mailroom-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from mailroom.sources.fixtures import Fixtures
    return Fixtures(spark, SMOKE)
