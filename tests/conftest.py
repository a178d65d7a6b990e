import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def put(tmp_path):
    """Write a file and return its path."""
    def write(content, name="data.csv"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return write


@pytest.fixture(scope="session")
def churners(spark):
    """120 rows: an id, a category, missing salaries, one extreme salary, a 100/20 target."""
    cities = ("NY", "LA", "SF", "CHI")
    rows = [
        (f"C{i:05d}", float(30 + i % 25), None if i < 5 else 5e6 if i == 5 else 40000.0 + i % 30 * 1000, cities[i % 4],
         int(i >= 100))
        for i in range(120)
    ]
    return spark.createDataFrame(rows, "Customer_ID string, age double, salary double, city string, churn long")
