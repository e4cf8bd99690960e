"""Every registered question against its SQL, on the smallest tables."""

import pytest
from compare import assert_same, connect

from atlasweave.plans import question_queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_question_has_sql():
    assert set(question_queries.QUERIES) == set(question_queries.ORACLES) and len(question_queries.QUERIES) == 38


@pytest.mark.parametrize("name", list(question_queries.ORACLES))
def test_question_equals_sql(spark, sf_dir, duck, name):
    found = question_queries.QUERIES[name](spark, sf_dir)
    assert_same(found, duck, question_queries.ORACLES[name])
    assert found.take(1), "a question without an answer tests nothing"
