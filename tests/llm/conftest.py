import pytest


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame; extra columns with clashing names are easy to add."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
