from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column over a single row: ``value(lambda F-column...: column, inputs...)``."""
    from pyspark.sql import functions as F

    def run(fn, *inputs, ddl="STRING"):
        names = [f"c{i}" for i in range(len(inputs))]
        df = spark.createDataFrame([tuple(inputs)], ", ".join(f"{n} {ddl}" for n in names))
        return df.select(fn(*[F.col(n) for n in names])).first()[0]

    return run
