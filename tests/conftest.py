import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from condensa.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Value of a column function applied to one row."""

    def value(function, **cells):
        row = spark.createDataFrame([tuple(cells.values())], list(cells))
        return row.select(function.alias("v")).first()["v"]

    return value
