import pytest

from strandline.plans.queries import QUERIES
from strandline.plans.sql import ORACLE_SQL

from .oracle import compare

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, D), ORACLE_SQL[name], D) > 0
