import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomscope.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(4, "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
