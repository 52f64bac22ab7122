"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from flowlens.plans import registry

from .oracle import assert_same, connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    if name in registry.ORACLE_SQL:
        assert_same(df, con, registry.ORACLE_SQL[name])
    else:
        assert df.columns
        df.count()


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
