"""Bloom filters as aggregates and predicates, and a join that uses one before its shuffle.

Spark has both as expressions for its own run-time filters; here they are columns, so a filter can be built, stored and applied
where Spark's rules don't see the chance. They run in generated code. A filter never drops a row that matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

#: Different keys up to which a filter is built; at 10 bits a key (one row in a hundred passes by mistake) it has 5 MB at most.
MAX_KEYS, BITS_PER_KEY = 4_000_000, 10


def _java(df: DataFrame):  # noqa: ANN202
    """Spark's expressions, and the way from columns to them and back."""
    sql = df.sparkSession._jvm.org.apache.spark.sql
    return sql.catalyst.expressions, sql.classic.ExpressionUtils


def bloom(df: DataFrame, keys: Sequence[str], expected: int) -> Column:
    """Aggregate: a Bloom filter of the keys' hashes (binary; null for no rows). ``expected``: how many different ones."""
    ex, way = _java(df)
    n = max(1, min(expected, MAX_KEYS))
    parts = [way.expression(c._jc) for c in (F.xxhash64(*keys), F.lit(n).cast("bigint"), F.lit(n * BITS_PER_KEY).cast("bigint"))]
    return ClassicColumn(way.column(ex.aggregate.BloomFilterAggregate(*parts).toAggregateExpression()))


def might_contain(df: DataFrame, made: bytes, keys: Sequence[str]) -> Column:
    """Predicate: whether the keys may be among those of the filter."""
    ex, way = _java(df)
    return ClassicColumn(way.column(ex.BloomFilterMightContain(way.expression(F.lit(bytes(made))._jc), way.expression(F.xxhash64(*keys)._jc))))


def bloom_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join (inner or left_semi) whose left rows are filtered by the right side's keys before they are shuffled, where those
    are at most MAX_KEYS; beyond that it is the plain join. Null keys match nothing. An empty right side gives no row."""
    if how not in ("inner", "left_semi"):
        raise ValueError(how)
    on = list(on)
    some = right.where(" AND ".join(f"`{k}` IS NOT NULL" for k in on))
    keys = some.agg(F.approx_count_distinct(F.xxhash64(*on))).first()[0]
    if keys > MAX_KEYS:
        return left.join(right, on, how)
    # Hashes depend on the types: those of the left side count.
    kinds = dict(left.dtypes)
    made = some.select(*[F.col(k).cast(kinds[k]).alias(k) for k in on]).agg(bloom(right, on, keys + keys // 10 + 1)).first()[0]
    return (left.where(might_contain(left, made, on)) if made is not None else left.limit(0)).join(right, on, how)
