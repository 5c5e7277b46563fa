"""Problem 1: exact percentiles per group over billions of values, from partial results that can be combined.

A *run* is one row per (group, part, measure, value) with the number of rows that hold the value: a sorted, counted
multiset. Runs of different days or loads are combined by adding counts (``merge_runs``), so nothing is lost by computing
them apart. ``percentiles_from_runs`` sorts the runs over the whole cluster, counts each group's rows per partition, turns
those counts into offsets, locates the target positions and reads the one or two neighbouring order statistics there.
The rank error is 0, for any split into parts.

Defined cases: null measures don't count; a null group is a group of its own; NaN counts as the largest value and -0.0 as
0.0; an empty table, or a group without values, gives no row; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

#: Rank error of every percentile given here.
RANK_ERROR = 0


def _common_type(types: list[T.DataType]) -> T.DataType:
    """One type that holds every measure exactly (double if any is a float)."""
    if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in types):
        return T.DoubleType()
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    whole, scale = 1, 0
    for t in types:
        digits = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}.get(t.simpleString())
        p, s = (t.precision, t.scale) if isinstance(t, T.DecimalType) else (digits or 19, 0)
        whole, scale = max(whole, p - s), max(scale, s)
    return T.DecimalType(min(38, whole + scale), scale)


def runs(df: DataFrame, groups: Sequence[str], measures: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """Counted values: columns ``groups``, ``parts``, measure, value, n. One scan and one map-side combined shuffle, whose size is that
    of the distinct values rather than of the rows; equal values of a hot group become one row."""
    kind = _common_type([df.schema[m].dataType for m in measures])

    def value(m: str) -> Column:
        v = F.col(m).cast(kind)
        return F.when(v == 0, F.lit(0.0)).otherwise(v) if isinstance(kind, T.DoubleType) else v

    each = F.array(*[F.struct(F.lit(m).alias("measure"), value(m).alias("value")) for m in measures])
    long = df.select(*groups, *parts, F.inline(each)).where(F.col("value").isNotNull())
    return long.groupBy(*groups, *parts, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_runs(a: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Runs without their parts: counts of equal values are added."""
    return a.groupBy(*groups, "measure", "value").agg(F.sum("n").alias("n"))


def _number(schema: T.StructType, keys: list[str]):
    """For sorted partitions: adds the partition's number and, within partition and group, the ranks that each row covers."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy(zero_copy_only=False)
            starts = np.zeros(b.num_rows, bool)
            for k in keys:
                c = b.column(k)
                if isinstance(c.type, pa.DictionaryType):
                    c = c.dictionary_decode()
                x, y = c.slice(0, len(c) - 1), c.slice(1)
                same = pa.compute.fill_null(pa.compute.equal(x, y), False).to_numpy(zero_copy_only=False)
                both = pa.compute.and_(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False)
                starts[1:] |= ~(same | both)
            first = tuple(b.column(k)[0].as_py() for k in keys)
            starts[0] = first != last
            total = np.cumsum(n)
            at = np.flatnonzero(starts)
            before = np.zeros(b.num_rows, np.int64)  # what has been summed up before the row's group began in this batch
            before[at] = total[at] - n[at]
            before = np.maximum.accumulate(before)
            carried = np.zeros(b.num_rows, np.int64)
            carried[: at[0] if len(at) else b.num_rows] = seen
            upto = total - before + carried
            last, seen = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys), int(upto[-1])
            cols = [b.column(k) for k in keys] + [b.column("value"), pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(upto - n), pa.array(upto)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "value", "pid", "before", "upto"])

    return go, T.StructType([*(schema[k] for k in keys), T.StructField("value", schema["value"].dataType), T.StructField("pid", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("upto", T.LongType())])


def percentiles_from_runs(run: DataFrame, groups: Sequence[str], percents: Sequence[float]) -> DataFrame:
    """One row per group, measure and percent: ``n`` values, ``at_least`` (the smallest value such that at least pct percent
    of the values lie at or below it), ``interpolated`` (linear between the two order statistics around (n - 1) * pct / 100)
    and ``rank_error`` (0). ``run``: merged runs. Percents lie in 0..100 and have at most four decimals."""
    keys = [*groups, "measure"]
    ranged = run.select(*keys, "value", "n").repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value")
    go, schema = _number(ranged.schema, keys)
    # Written, so that the partition numbers of both uses below are the same even if a task is run again.
    placed = written(ranged.mapInArrow(go, schema), "percentile-runs")
    per_part = placed.groupBy(*keys, "pid").agg(F.max("upto").alias("rows"))  # at most partitions + groups rows
    by_group = W.partitionBy(*keys)
    offsets = per_part.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("pid").alias("_pid"),
        (F.sum("rows").over(by_group.orderBy("pid")) - F.col("rows")).alias("_offset"),
        F.sum("rows").over(by_group).alias("_n"),
    )
    on = F.col("pid") == F.col("_pid")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    ps = F.array(*[F.lit(round(p * 10_000)).cast("bigint") for p in percents])
    # Positions in millionths: whole-number arithmetic, exact up to 9e12 values a group.
    wanted = F.expr(
        "transform(_ps, p -> named_struct('p', p, 'need', greatest(1L, (_n * p + 999999L) div 1000000L), 'lo', ((_n - 1) * p) div 1000000L + 1,"
        " 'hi', ((_n - 1) * p + 999999L) div 1000000L + 1, 'share', (((_n - 1) * p) % 1000000L) / 1000000D))"
    )
    low, high = F.col("_offset") + F.col("before"), F.col("_offset") + F.col("upto")
    inside = lambda r: (r > low) & (r <= high)
    hit = placed.join(offsets, on).withColumn("_ps", ps).select(
        *keys, "value", "_n", low.alias("low"), high.alias("high"), F.explode(F.filter(wanted, lambda t: inside(t["need"]) | inside(t["lo"]) | inside(t["hi"]))).alias("t")
    )
    within = lambda r: (r > F.col("low")) & (r <= F.col("high"))
    v = F.col("value").cast("double")
    got = hit.groupBy(*keys, F.col("t.p").alias("p"), F.col("_n").alias("n")).agg(
        F.max(F.when(within(F.col("t.need")), F.col("value"))).alias("at_least"),
        F.max(F.when(within(F.col("t.lo")), v)).alias("_lo"),
        F.max(F.when(within(F.col("t.hi")), v)).alias("_hi"),
        F.max("t.share").alias("_share"),
    )
    between = F.when(F.col("_share") == 0, F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share"))
    return got.select(*keys, (F.col("p") / 10_000).alias("pct"), "n", "at_least", between.alias("interpolated"), F.lit(RANK_ERROR).alias("rank_error"))


def percentiles(df: DataFrame, groups: Sequence[str], measures: Sequence[str], percents: Sequence[float]) -> DataFrame:
    """Percentiles of the rows of ``df``; see ``percentiles_from_runs``."""
    return percentiles_from_runs(runs(df, groups, measures), groups, percents)
