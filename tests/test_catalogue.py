import pytest

from curator.plans import catalogue
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    query, sql = catalogue.queries()[name], catalogue.oracle_sql().get(name)
    if sql:
        compare(spark, connect(SF), query, sql, SF)
    else:
        assert query(spark, SF).count() >= 0
