"""Every registered query of the core runs at the smallest scale and agrees with its SQL."""

import pytest

import oracle
from weftgraph.plans import all as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    f, sql = core.queries()[name], core.oracle_sql().get(name)
    if sql:
        assert oracle.compare(spark, con, name, f, sql, SF) == ""
    else:
        assert f(spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 10
    assert set(e.oracle_sql()) <= set(e.queries())
