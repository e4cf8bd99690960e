"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import assert_same, connect

from atlasweave.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert_same(catalogue.QUERIES[name](spark, sf_dir), duck, catalogue.ORACLES[name])


def test_entry_has_rows(spark, sf_dir):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert set(found.columns) == {"param", "question", "answers", "gaps", "status", "task", "verdict", "blockers"}
    assert found.take(1)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.bgp_optional_order(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "o_totalprice" not in plan
