import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from dischargelab.session import get_spark

    s = get_spark("tests", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tight(spark):
    """A session whose group bound forces the segmented and chunked paths."""
    from dischargelab.session import BROADCAST_ROWS_CONF, GROUP_ROWS_CONF

    spark.conf.set(GROUP_ROWS_CONF, "40")
    spark.conf.set(BROADCAST_ROWS_CONF, "2")
    yield spark
    spark.conf.unset(GROUP_ROWS_CONF)
    spark.conf.unset(BROADCAST_ROWS_CONF)
