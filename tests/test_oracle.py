"""Every registered query of the core against its SQL on a second engine."""

import pytest

import __spark_entry__ as entry
from cleansheet.registry import oracle, queries
from compare import differences

FOLDER = "/root/testdata/sf0.001"
QUERIES = queries.queries()
ORACLE = oracle.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert differences(spark, FOLDER, name, QUERIES[name], ORACLE[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 2
