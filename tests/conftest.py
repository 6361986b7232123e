import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(__file__), os.path.join(os.path.dirname(__file__), "..")]

from oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
