"""Every registered query that has SQL against DuckDB: on the smallest tables, and whole sheets on the middle ones."""

import pytest

from sheetwise.plans import catalog

WHOLE = [n for n in catalog.ORACLE if n.startswith("interpret_")]


@pytest.mark.parametrize("name", [n for n in catalog.ORACLE if n not in WHOLE])
def test_matches_sql(compare, name):
    compare(name)


@pytest.mark.parametrize("name", WHOLE)
def test_whole_sheets_match_sql(compare, name):
    compare(name, "sf0.01")


def test_every_query_has_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
