"""Registered queries of the subpackage against their SQL on a second engine."""

import pytest
from compare import differences

from cleansheet.llm import queries

ORACLE = queries.oracle_sql()


@pytest.mark.parametrize("name", list(ORACLE))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, name, size):
    assert differences(spark, f"/root/testdata/{size}", name, queries.queries()[name], ORACLE[name]) == []
