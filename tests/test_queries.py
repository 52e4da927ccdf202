"""Every query of the registry runs; where it has SQL, both give the same rows."""

import pytest

from folioscan import queries as registry
from tests.oracle import compare, connection

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    if name in SQL:
        compare(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(registry.queries())


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert e.entry(spark).count() > 0
