"""Registered queries against their SQL twins, and the entry's guard."""

import pytest

import __spark_entry__
from demandloom.llm import queries
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_twin(spark, small, name):
    assert compare(queries.QUERIES[name](spark, small), connect(small), queries.ORACLE_SQL[name]) is None


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "pipeline" in names
