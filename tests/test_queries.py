"""Every registered query against its SQL."""

import pytest
from compare import connect, differences

from veilframe.catalog import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, con, name):
    item = REGISTRY[name]
    assert item.sql is not None
    assert differences(item.run(spark, SF_DIR), con, item.sql) == []


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
