"""Every query of the core against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from comparing import DATA, same_as_duckdb

from tessera.queries.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    same_as_duckdb(QUERIES[name](spark, DATA), duck, SQL[name])


def test_every_query_of_the_core_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_without_the_training_data_operators(spark, duck):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
