from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from comparing import DATA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_or_create

    s = get_or_create(cores=4, shuffle_partitions=4)
    yield s
    from tessera import scratch

    scratch.clear()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the test tables as views."""
    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con
