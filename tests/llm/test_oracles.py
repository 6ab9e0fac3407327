import pytest

from strandline.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir) > 0
