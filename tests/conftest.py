import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from wordloom.session import spark_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = spark_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def column(spark):
    """Apply a column function to a list of values and return the results in order."""
    from pyspark.sql import functions as F

    def run(fn, values, dtype="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {dtype}")
        return [r[0] for r in df.repartition(3).select(fn(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]

    return run


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
