"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from actlens.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def strings(spark):
    """Evaluate a column function on a list of strings, in order."""
    from pyspark.sql import functions as F

    def run(fn, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
        return [r.x for r in df.select("i", fn(F.col("s")).alias("x")).orderBy("i").collect()]

    return run
