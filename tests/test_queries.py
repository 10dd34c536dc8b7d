"""Every registered core query against its SQL on the small tables, and the entry point."""

import os

import pytest
from oracle import NOTHING, differences

from strandline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
#: Finds nothing in the given tables; tests/test_whole_tables.py has a fixture in which it does.
FOUND_ELSEWHERE = {"rsk04_control_samples"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    found = differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
    if found == NOTHING:  # too small a table for this query
        found = differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], LARGER)
    assert found == "" or found == NOTHING and name in FOUND_ELSEWHERE


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
