import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from podium.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app_name="podium-tests")
    yield s
    s.stop()


@pytest.fixture
def distributed(spark):
    """Many small blocks for the duration of a test."""
    spark.conf.set("podium.ordering.blocks", "23")
    yield spark
    spark.conf.unset("podium.ordering.blocks")


SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
