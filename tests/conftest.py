import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from hyperlake.session import local_session

    session = local_session(8, "tests", "6g")
    yield session
    session.stop()


@pytest.fixture
def tiny_chunks(spark):
    """Split every key of more than a few rows, so the hot-key path runs."""
    spark.conf.set("hyperlake.rowsPerChunk", "5")
    yield spark
    spark.conf.unset("hyperlake.rowsPerChunk")
