import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TICKLOOM_PARTITIONS", "4")


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import get_spark
    return get_spark("tests", 4)
