"""Queries of the training-data operators that SQL can express, over the smallest tables."""

import pytest

from lexmill.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    pytest.importorskip("duckdb")
    assert compare(spark, connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) is None
