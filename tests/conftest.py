import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from demogrid.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "4", 4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
