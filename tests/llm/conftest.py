import os

import pytest


@pytest.fixture(scope="session", autouse=True)
def package_on_worker_path(spark):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment["PYTHONPATH"] = root


@pytest.fixture
def docs(spark):
    """Make a documents table from (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
