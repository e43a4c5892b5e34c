import datetime as dt
import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BASE = dt.datetime(2025, 6, 1, 0, 0)


def at(hours: float) -> dt.datetime:
    return BASE + dt.timedelta(hours=hours)


@pytest.fixture(scope="session")
def spark():
    os.environ["TZ"] = "UTC"
    session = (SparkSession.builder.master("local[4]").appName("telewatch-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="telewatch-tests-")).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
