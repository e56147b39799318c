"""Every registered query against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as E
from refinery.plans.oracle import ORACLE
from refinery.plans.registry import QUERIES
from refinery.plans.verify import compare, duck

from conftest import SF_SMALL

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    n, problems = compare(E.queries()[key](spark, SF_SMALL), con, E.oracle_sql().get(key))
    assert not problems, problems


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and df.columns == ["c_custkey", "c_name", "n_name", "c_acctbal"]
