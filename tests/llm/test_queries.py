"""Queries that SQL can express, against SQL."""

import pytest
from compare import connect, differences

from numerale.llm.queries import QUERIES, oracle


@pytest.mark.parametrize("name", sorted(oracle()))
def test_same_as_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), oracle()[name], connect(sf)) is None
