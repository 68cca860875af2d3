import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from cueflow.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("CUEFLOW_DRIVER_MEMORY", "4g")
    s = get_session("tests", "local[4]")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture
def rows():
    return lambda df, *order: [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
