import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from labspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Make a small frame: rows(schema, (…), (…))."""
    return lambda schema, *values: spark.createDataFrame(list(values), schema)
