"""Every query of the reference's operators against DuckDB."""

import pytest
from compare import assert_same

from lumenframe.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(name, spark, duck, sf_dir):
    assert_same(registry.QUERIES[name](spark, sf_dir), duck.sql(registry.ORACLES[name]))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
