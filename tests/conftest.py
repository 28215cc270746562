import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from tidemark.session import BLOCK_ROWS_KEY, DEFAULTS, FOLD_ROWS_KEY, HOT_ROWS_KEY, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", memory="12g")


@pytest.fixture(params=["usual", "hot"])
def sized(request, spark):
    """Run a test with the usual size limits and with limits that make every group hot."""
    small = {HOT_ROWS_KEY: 4, FOLD_ROWS_KEY: 6, BLOCK_ROWS_KEY: 5}
    for key, value in (small if request.param == "hot" else DEFAULTS).items():
        spark.conf.set(key, str(value))
    yield spark
    for key, value in DEFAULTS.items():
        spark.conf.set(key, str(value))
