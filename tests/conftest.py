import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import local_session

    session = local_session("4", 4, "ledgerline-tests")
    yield session
    session.stop()


@pytest.fixture()
def split_small(spark):
    """Cut every group above 40 rows, so that the split paths run on test data."""
    spark.conf.set("spark.ledgerline.minSplitRows", "40")
    yield
    spark.conf.unset("spark.ledgerline.minSplitRows")
