"""Every query of the engine against its SQL."""

import pytest

import claimgraph.queries as Q
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    if name in Q.ORACLES:
        compare(df, Q.ORACLES[name], con)
    else:
        assert df.count() > 0
