"""Problem 2: the N best items of every group, ties settled by the smaller identifier.

Each input partition keeps a bounded heap of N items per group, built batch by batch before the shuffle; the heaps of all
partitions are merged afterwards by the same comparison (score first, then identifier). A heap that left its partition can
be stored and merged later with others (``merge_heaps``): an item among the N best of the whole is among the N best of
every partition in which it reaches its highest score.

Defined cases: rows with a null group, item or score (or a NaN) don't count; an item stands once per group, with its highest score;
an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..parallel import spread

#: Rows of heaps that one task holds before it hands them on and starts anew; it bounds memory, not the result.
MAX_HEAP_ROWS = 1_000_000
BATCH_ROWS = 200_000


def _pruned(frames: list[pd.DataFrame], keys: list[str], item: str, n: int) -> pd.DataFrame:
    x = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
    x = x.groupby([*keys, item], sort=False, as_index=False)["_score"].max()
    x = x.sort_values(["_score", item], ascending=[False, True], kind="stable")
    return x.groupby(keys, sort=False).head(n)


def heaps(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int) -> DataFrame:
    """The heaps of the input partitions: at most n rows per group and partition (or per MAX_HEAP_ROWS rows of heaps)."""
    groups = list(groups)
    kind = df.schema[score].dataType
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:  # whole numbers compare alike and are fast
        s = (F.col(score) * F.lit(10**kind.scale)).cast("bigint")
    else:
        s = F.col(score)
    x = df.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.col(item).alias("item"), s.alias("_score")).dropna()
    keys = [f"g{i}" for i in range(len(groups))]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap, waiting, rows = None, [], 0
        for b in batches:
            waiting.append(b)
            rows += len(b)
            if rows >= BATCH_ROWS:
                heap = _pruned(([heap] if heap is not None else []) + waiting, keys, "item", n)
                waiting, rows = [], 0
                if len(heap) > MAX_HEAP_ROWS:
                    yield heap
                    heap = None
        if waiting:
            heap = _pruned(([heap] if heap is not None else []) + waiting, keys, "item", n)
        if heap is not None and len(heap):
            yield heap

    out = spread(x).mapInPandas(go, x.schema)
    back = (F.col("_score").cast("decimal(38,0)") / F.lit(10**kind.scale)).cast(kind) if isinstance(kind, T.DecimalType) and kind.precision <= 18 else F.col("_score")
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], F.col("item").alias(item), back.alias(score))


def merge_heaps(heap: DataFrame, groups: Sequence[str], item: str, score: str, n: int) -> DataFrame:
    """The n best items per group out of heaps of any origin, with their rank from 1."""
    best = heap.groupBy(*groups, item).agg(F.max(score).alias(score))
    place = F.row_number().over(W.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(item).asc()))
    return best.withColumn("_place", place).where(F.col("_place") <= n).withColumnRenamed("_place", "place")


def top_n(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int) -> DataFrame:
    """The n items of highest score in every group: columns ``groups``, ``item``, ``score``, place."""
    return merge_heaps(heaps(df, groups, item, score, n), groups, item, score, n)
