"""Rewrites that Catalyst doesn't do, as functions the caller chooses. Each gives the same rows as its plain form."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multi_agg(df: DataFrame, named: Mapping[str, tuple[Column | None, str, Column]]) -> DataFrame:
    """Scalar aggregates with filters of their own in one scan, instead of a sub-query each. named: name -> (filter or None,
    function name, argument). The filters' disjunction is pushed to the scan if every aggregate has one (rows in no filter can't
    count). An aggregate's own filter is always kept."""
    filters = [f for f, _, _ in named.values()]
    if filters and all(f is not None for f in filters):
        any_of = filters[0]
        for f in filters[1:]:
            any_of = any_of | f
        df = df.where(any_of)
    functions = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct, "stddev_samp": F.stddev_samp}
    return df.agg(*[functions[a](x if f is None else F.when(f, x)).alias(n) for n, (f, a, x) in named.items()])


#: How partial results of a decomposable aggregate are put together.
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def rollup_from_finest(df: DataFrame, keys: Sequence[str], named: Mapping[str, tuple[str, str]], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """ROLLUP (or other grouping sets) out of the finest level: rows are aggregated once by all keys, and only those results
    are expanded, instead of every row. named: name -> (sum, count, min, max or avg; column). ``grouping_id`` as in SQL."""
    keys = list(keys)
    sets = [keys[:i] for i in range(len(keys), -1, -1)] if sets is None else sets
    parts: dict[str, tuple[str, str]] = {}
    for n, (f, c) in named.items():
        parts |= {f"_s_{n}": ("sum", c), f"_c_{n}": ("count", c)} if f == "avg" else {f"_p_{n}": (f, c)}
    plain = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    finest = df.groupBy(*keys).agg(*[plain[f](F.col(c)).alias(n) for n, (f, c) in parts.items()])
    again = [_MERGE[f](F.col(n)).alias(n) for n, (f, _) in parts.items()]
    out = finest.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("grouping_id"), *again)
    return out.select(*keys, "grouping_id", *[(F.col(f"_s_{n}") / F.col(f"_c_{n}") if f == "avg" else F.col(f"_p_{n}")).alias(n) for n, (f, _) in named.items()])


def count_distinct_two_level(df: DataFrame, keys: Sequence[str], column: str, name: str, *others: tuple[str, str, str]) -> DataFrame:
    """``count(DISTINCT column)`` beside other aggregates without Expand: by keys and column first, then by keys. others: (name,
    sum, count, min or max; column)."""
    plain = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    first = df.groupBy(*keys, column).agg(*[plain[f](F.col(c)).alias(f"_{n}") for n, f, c in others] or [F.lit(1).alias("_")])
    return first.groupBy(*keys).agg(F.count(column).alias(name), *[_MERGE[f](F.col(f"_{n}")).alias(n) for n, f, _ in others])


def semi_join_distinct(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join against the distinct keys of the right side: repeated keys are dropped before the shuffle."""
    return left.join(right.select(*on).distinct(), list(on), how)


def keys_with_several(df: DataFrame, key: str, other: str) -> DataFrame:
    """Keys that occur with more than one value of ``other``: what ``SELECT a.key FROM t a, t b WHERE a.key = b.key AND a.other
    <> b.other`` finds, as an aggregate instead of a self join. Nulls in ``other`` don't count, a null key isn't given."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(other).alias("_lo"), F.max(other).alias("_hi")).where("_lo <> _hi").select(key)


def top_groups(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], n: int, *aggregates: Column) -> DataFrame:
    """``GROUP BY keys ORDER BY order LIMIT n`` where every sort key is a grouping column: the n groups are found from the
    distinct sort keys first, and only their rows are aggregated. order: (column, ascending). Ties on the sort keys are kept
    until the last step, so no group is lost even if the sort keys are only some of the grouping columns."""
    cols = [c for c, _ in order]
    if not set(cols) <= set(keys):
        raise ValueError("a sort key is not a grouping column")
    by = [F.col(c).asc_nulls_first() if a else F.col(c).desc_nulls_last() for c, a in order]
    first = df.select(*cols).distinct().orderBy(*by).limit(n)
    cond = None
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = e if cond is None else cond & e
    first = first.select(*[F.col(c).alias(f"_{c}") for c in cols])
    kept = df.join(F.broadcast(first) if n <= 10_000 else first, cond, "left_semi")  # n rows of sort keys
    rest = [F.col(k).asc_nulls_first() for k in keys if k not in cols]
    return kept.groupBy(*keys).agg(*aggregates).orderBy(*by, *rest).limit(n)


def in_year(column: str, year: int) -> Column:
    """``year(column) = year`` as a range of the column itself, which reaches the scan."""
    return (F.col(column) >= F.lit(dt.date(year, 1, 1))) & (F.col(column) < F.lit(dt.date(year + 1, 1, 1)))


def in_month(column: str, year: int, month: int) -> Column:
    """``year(column) = year AND month(column) = month`` as a range."""
    end = dt.date(year + month // 12, month % 12 + 1, 1)
    return (F.col(column) >= F.lit(dt.date(year, month, 1))) & (F.col(column) < F.lit(end))


def parse_once(df: DataFrame, column: str, schema: str, fields: Sequence[str]) -> DataFrame:
    """Several ``get_json_object`` of one column as a single ``from_json``."""
    parsed = df.withColumn("_json", F.from_json(F.col(column), schema))
    return parsed.select(*df.columns, *[F.col(f"_json.{f}").alias(f) for f in fields])
