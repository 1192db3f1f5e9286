import pytest

from plumbline.llm.queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], "sf0.001") > 0
