"""Aggregations that Spark has no single call for.

Nulls are handled as SQL does (they don't count); empty inputs give no group, or one row for a global aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_all(*columns: str) -> Column:
    """``count(a, b, ...)``: rows in which none of the columns is null."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return F.count(F.when(cond, 1))


def grouping_sets(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """``GROUP BY GROUPING SETS`` with the level's number as ``grouping_id``; one pass (Expand) over the rows."""
    order = [[F.col(c) for c in s] for s in sets]
    return df.groupingSets(order, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("grouping_id"), *aggregates)


def two_level_sum(df: DataFrame, keys: Sequence[str], value: str, salts: int = 32, name: str = "total") -> DataFrame:
    """Sum per key in two levels, for measures whose map-side combination is switched off or of no use: each key's rows are
    first added up in ``salts`` parts (by a hash of row and partition, which a task that runs again repeats), so a hot key is spread
    over as many tasks."""
    part = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.lit(salts))).groupBy(*keys, "_salt").agg(F.sum(value).alias("_part"))
    return part.groupBy(*keys).agg(F.sum("_part").alias(name))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, ties: str = "row_number") -> DataFrame:
    """The first n rows per group: ``ties`` is row_number (exactly n), rank or dense_rank (ties kept). Spark limits groups before
    the shuffle (WindowGroupLimit)."""
    from pyspark.sql import Window as W

    f = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[ties]
    return df.withColumn("_place", f().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n).drop("_place")
