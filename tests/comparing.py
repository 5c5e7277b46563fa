"""Comparison of rows without regard to their order, for the tests."""

from __future__ import annotations

import decimal
import math

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, int):
        return f"{v:.6g}" if abs(v) < 100_000 else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(values, order) -> list[tuple]:
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


def same_as_duckdb(df, con, sql: str) -> None:
    got, cols = df.collect(), df.columns
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(cols) == sorted(names)
    assert rows(got, [cols.index(c) for c in sorted(cols)]) == rows(res.fetchall(), [names.index(c) for c in sorted(cols)])
