import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tests.check_oracles import session

    made = session(partitions=3)
    yield made
    made.stop()


@pytest.fixture
def table(spark):
    """Make a small table from a schema and rows."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)
