"""Every registered query with SQL gives the same bag of rows as DuckDB."""

import pytest

from ordlog.plans.queries import ORACLE, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    if name not in ORACLE:
        assert QUERIES[name](spark, SF).count() > 0
        return
    ours, theirs = compare(spark, con, SF, QUERIES[name], ORACLE[name])
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
    assert ours[1]
