"""Every registered query of this subpackage runs at the smallest scale and agrees with its SQL."""

import pytest

import oracle
from weftgraph.llm import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, name):
    f, sql = plans.queries()[name], plans.oracle_sql().get(name)
    if sql:
        assert oracle.compare(spark, oracle.connect(SF), name, f, sql, SF) == ""
    else:
        assert f(spark, SF).count() >= 0
