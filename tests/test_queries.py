"""Every query of the incident operators against its DuckDB SQL, on the smallest tables."""

import pytest
from compare import both

from casebook.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    mine, theirs = both(spark, name, QUERIES[name], ORACLES[name], FOLDER)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
