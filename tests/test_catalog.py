"""Every catalogue query runs; those with SQL equal DuckDB on the same tables."""

import pytest

import compare
from lorewell import catalog


#: Queries that find nothing in tables of this size.
EMPTY = {"embedding_cache_misses", "near_dup_token_overlap"}


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    got = compare.rows(df)
    assert got or name in EMPTY
    if name in catalog.ORACLE_SQL:
        names, want = compare.sql_rows(con, catalog.ORACLE_SQL[name])
        assert sorted(df.columns) == names
        assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
