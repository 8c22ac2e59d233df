import pytest

from brinemark.plans.catalogue import ORACLES, QUERIES
from tests.harness import compare, sf

DATA = sf()


@pytest.mark.skipif(DATA is None, reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, DATA, QUERIES[name], ORACLES[name]) > 0


@pytest.mark.skipif(DATA is None, reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
