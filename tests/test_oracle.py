"""Every registered query equals its DuckDB oracle on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# queries without SQL are compared with brute force in their own tests
@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["division", "average_distance", "#"]
    assert df.count() >= 0


def test_every_reference_query_has_an_oracle():
    known = set(E.oracle_sql())
    extra = set() if E.llm_queries is None else {*E.llm_queries.queries(), "pipeline"}
    assert set(E.queries()) - extra <= known
