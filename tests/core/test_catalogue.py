"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest

from reconspark.plans import catalogue

from ..oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalogue.queries()[name], catalogue.SQL[name], SF)


def test_entry_lists_everything():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
