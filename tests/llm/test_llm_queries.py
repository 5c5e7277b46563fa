from __future__ import annotations

import pytest
from comparing import same_as_duckdb

from tessera.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": [("ss_store_sk", "bigint"), ("measure", "string"), ("pct", "bigint"), ("value_x100", "bigint")],
    "p2_found": [("ss_store_sk", "bigint"), ("ss_item_sk", "bigint")],
    "p3_found": [("ss_sold_date_sk", "bigint"), ("ss_store_sk", "bigint")],
    "p5_found": [("write_id", "bigint"), ("piece_no", "bigint")],
    "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p7_found": [("source", "string"), ("n_passes", "bigint"), ("falls_short", "bigint")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    same_as_duckdb(QUERIES[name](spark, DATA), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, duck, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_are_those_asked_for(spark, duck, name):
    assert QUERIES[name](spark, DATA).dtypes == COLUMNS[name]


def test_entry_has_the_queries():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
