"""Queries of the subpackage against their SQL."""

import pytest

from cidrloom.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name])
