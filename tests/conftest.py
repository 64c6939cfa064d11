import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one_column(spark, values, kind="string"):
    """Values in a column ``c`` with their position ``i``."""
    return spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")


def values(df, column):
    return [r[1] for r in sorted(tuple(r) for r in df.select("i", column).collect())]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
