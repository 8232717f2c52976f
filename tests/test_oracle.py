"""Every query with SQL agrees with it on the smallest tables."""

import pytest

from oracle_check import compare, connect
from workload import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, con, name):
    df = QUERIES[name](spark, tiny)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
