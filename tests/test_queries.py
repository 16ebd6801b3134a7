"""Every query of the quality operators against DuckDB."""

import pytest
from oracle import compare, connect

from granary import queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", queries.NAMES)
def test_equals_sql(spark, sf, con, name):
    assert not compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], sf)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
