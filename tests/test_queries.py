"""Every registered query of the core against its DuckDB statement, on the smallest tables."""

import pytest
from helpers import SMALL, same

from textloom.registry import ORACLES, QUERIES


def test_all_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
