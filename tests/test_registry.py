"""Every registered query against its comparison SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest
from compare import compare, connection

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF_DIR)


def test_every_comparison_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    # "EMPTY" is an equal result without rows, which the smallest tables allow.
    assert compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) in ("", "EMPTY")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
