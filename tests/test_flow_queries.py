"""The queries over flows made from the tables against their SQL, on the smallest tables."""

import pytest
from compare import assert_same, connect

from atlasweave.plans import flow_queries


@pytest.mark.parametrize("name", list(flow_queries.ORACLES))
def test_flow_query_equals_sql(spark, sf_dir, name):
    found = flow_queries.QUERIES[name](spark, sf_dir)
    assert_same(found, connect(sf_dir), flow_queries.ORACLES[name])
    assert found.take(1), "a query without rows tests nothing"
