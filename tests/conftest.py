import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def perms(spark):
    """Build (perm_id, n_rows, pos, src) from {name: 1-based sequence}."""
    def make(named):
        rows = [(k, len(p), i + 1, int(s)) for k, p in named.items() for i, s in enumerate(p)]
        return spark.createDataFrame(rows, "perm_id string, n_rows bigint, pos bigint, src bigint")

    return make
