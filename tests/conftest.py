import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from segmenta.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", spark__master="local[4]", spark__ui__enabled="false", spark__driver__memory="4g",
                spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
