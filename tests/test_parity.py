import pytest
from parity import spark_rows, sql_rows

from carafe.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_the_query_gives_the_rows_of_its_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(SQL[name], sf)
