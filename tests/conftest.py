import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from qamill.session import build_session

SMALL = "/root/testdata/sf0.001"

# Column expressions at module level need a session when the tests are collected.
SESSION = build_session("tests", "local[8]", **{
    "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
    "spark.checkpoint.dir": tempfile.mkdtemp(prefix="shared-"),
})
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression on one row of values."""

    def run(expression, **values):
        from pyspark.sql import functions as F

        row = spark.range(1)
        for name, value in values.items():
            row = row.withColumn(name, F.lit(value))
        return row.select(expression.alias("x")).first()["x"]

    return run
