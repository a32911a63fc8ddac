import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from caseloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", f"local[{os.environ.get('TEST_CPUS', '8')}]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a Column expression over one row of named values."""

    def value(expression, **columns):
        schema = ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'long' if isinstance(v, int) else 'string'}" for k, v in columns.items())
        frame = spark.createDataFrame([tuple(columns.values())], schema)
        return frame.select(expression.alias("v")).first()["v"]

    return value
