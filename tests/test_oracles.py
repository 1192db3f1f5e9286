import pytest

from plumbline.plans.oracles import ORACLES
from plumbline.plans.queries import QUERIES
from tests.oracle import compare


#: Reports of what went wrong: nothing did on the smallest tables.
MAY_BE_EMPTY = {"q64_retrieval_misses"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], "sf0.001") > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
