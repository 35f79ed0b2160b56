import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from bendpoint.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    """A plainly built session, configured afterwards: what a caller with a session of their own has."""
    builder = SparkSession.builder.master("local[4]").appName("tests")
    for name, value in {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
    }.items():
        builder = builder.config(name, value)
    session = configure(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def series(spark):
    """Make a one-series table of numbers by row index."""

    def make(values, name="s"):
        rows = [(name, i, None if v is None else float(v)) for i, v in enumerate(values, start=1)]
        return spark.createDataFrame(rows, "series string, index long, value double")

    return make
