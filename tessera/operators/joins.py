"""Joins beyond what ``DataFrame.join`` states directly.

All of them accept nulls (a null key matches nothing, unless said otherwise), duplicate rows (every pair that matches is given),
empty sides, and sides whose other columns share names: the result's columns are the left side's, then the right side's with
``suffix`` added where the name is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows, and bytes (as JSON, which is no less than they take in memory but for long runs of equal values), up to which a side is
#: broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def _apart(left: DataFrame, right: DataFrame, suffix: str) -> tuple[DataFrame, dict[str, str]]:
    """The right side with names that the left doesn't have, and the new name of each."""
    taken, names = set(left.columns), {}
    for c in right.columns:
        n = c
        while n in taken:
            n += suffix
        taken.add(n)
        names[c] = n
    return right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes; stops reading just beyond the rows, so it never scans a large side in full."""
    wide = F.sum(F.octet_length(F.to_json(F.struct("*")))) if df.columns else F.lit(0)
    n, b = df.limit(rows + 1).agg(F.count(F.lit(1)), wide).first()
    return n <= rows and (b or 0) <= size


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Equi join that broadcasts the right side only after its rows and bytes were checked; a larger one is shuffled."""
    return left.join(F.broadcast(right) if small_enough(right, rows, size) else right, list(on), how)


def salted(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 16, hot_share: float = 0.001, suffix: str = "_r") -> DataFrame:
    """Equi join on one key in which the left side's hot keys (more than ``hot_share`` of its rows, so 1 / hot_share keys at most)
    are spread over ``salts`` tasks each; the right side's rows of just those keys are repeated. A row's salt is a hash of the row
    and its partition, so a task that runs again deals its rows out as before. ``how``: inner, left, left_semi or left_anti
    (joins that keep every right row can't be salted this way)."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    r, names = _apart(left, right, suffix)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = [x[0] for x in counts.where(F.col("_n") > max(1, total * hot_share)).select(key).collect()]
    rk = F.col(names[key])
    if not hot:
        return left.join(r, F.col(key) == rk, how)
    salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.lit(salts))).otherwise(0).cast("int")
    spread = F.when(rk.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    out = left.withColumn("_salt_l", salt).join(r.withColumn("_salt_r", F.explode(spread)), (F.col(key) == rk) & (F.col("_salt_l") == F.col("_salt_r")), how)
    return out.drop("_salt_l", "_salt_r")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: Sequence[str] = (), suffix: str = "_r") -> DataFrame:
    """Pairs with low <= point < high. Points and ranges meet in buckets, as an equi join, instead of comparing everything with
    everything. A range of up to ``width`` (a typical range's length) goes into the buckets of that width that it touches; longer
    ones into buckets of twice, four times ... the width, so none is repeated more than three times, however long; points are
    repeated for the widths that occur (63 at most, in practice one to three). Ranges with a null or crossed bound match nothing."""
    r, names = _apart(points, ranges, suffix)
    lo, hi = F.col(names[low]), F.col(names[high])
    kinds, rkinds = dict(points.dtypes), dict(ranges.dtypes)

    def number(c: Column, kind: str) -> Column:
        return (c.cast("timestamp") if kind in ("timestamp_ntz", "date") else c).cast("double")

    def bucket(c: Column, level: Column) -> Column:
        return F.floor(c / (F.pow(F.lit(2.0), level) * width)).cast("bigint")

    length = (number(hi, rkinds[high]) - number(lo, rkinds[low])) / width
    r = r.where(lo < hi).withColumn("_level_r", F.least(F.lit(62), F.greatest(F.lit(0), F.ceil(F.log2(length)))).cast("int"))
    levels = [x[0] for x in r.select("_level_r").distinct().collect()]
    r = r.withColumn("_bucket_r", F.explode(F.sequence(bucket(number(lo, rkinds[low]), F.col("_level_r")), bucket(number(hi, rkinds[high]), F.col("_level_r")))))
    p = points.withColumn("_level_l", F.explode(F.lit(levels or [0]).cast("array<int>"))).withColumn("_bucket_l", bucket(number(F.col(point), kinds[point]), F.col("_level_l")))
    cond = (F.col("_bucket_l") == F.col("_bucket_r")) & (F.col("_level_l") == F.col("_level_r")) & (F.col(point) >= lo) & (F.col(point) < hi)
    for k in on:
        cond = cond & (F.col(k) == F.col(names[k]))
    return p.join(r, cond).drop("_bucket_l", "_bucket_r", "_level_l", "_level_r")


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], by: str, right_by: str | None = None, values: Sequence[str] = (), suffix: str = "_r", chunks: int | None = None) -> DataFrame:
    """Every left row with the ``values`` of the right row of equal keys that is latest at or before it (by ``by``; the largest
    values among equals), or nulls. No pairs are made: both sides are united and the last right row is carried forward. Null keys
    form a key of their own; a left row with a null ``by`` gets nulls.

    The time that both sides span is cut into ``chunks`` equal stretches (as many as shuffle partitions by default). Rows are
    carried forward within (keys, stretch), and what a stretch ends with, one row each, is carried into the next ones, so a hot key
    is dealt out by time. ``by`` is a number, date or timestamp."""
    right_by = right_by or by
    names = {v: v + suffix if v in left.columns else v for v in values}
    none = F.lit(None)
    kinds = dict(left.dtypes)

    def number(c: Column) -> Column:
        return (c.cast("timestamp") if kinds[by] in ("timestamp_ntz", "date") else c).cast("double")

    ends = [x.agg(F.min(number(F.col(c))), F.max(number(F.col(c)))) for x, c in ((left, by), (right.where(F.col(right_by).isNotNull()), right_by))]
    ends = [v for e in ends for v in e.first() if v is not None]
    low, width = min(ends, default=0.0), (max(ends, default=0.0) - min(ends, default=0.0)) / (chunks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = left.select(*[F.col(c) for c in left.columns], F.lit(1).alias("_side"), F.col(by).alias("_at"), none.cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    other = right.where(F.col(right_by).isNotNull()).select(
        *[F.col(c) if c in on else none.cast(t).alias(c) for c, t in left.dtypes], F.lit(0).alias("_side"), F.col(right_by).cast(kinds[by]).alias("_at"), F.struct(*values).alias("_v")
    )
    chunk = F.coalesce(F.floor((number(F.col("_at")) - low) / width), F.lit(-1)).cast("int") if width > 0 else F.lit(0)
    both = both.unionByName(other).withColumn("_chunk", chunk)
    order = [F.col("_at").asc_nulls_first(), "_side", F.col("_v")]
    w = W.partitionBy(*on, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    # The last right row of every stretch, and with it what stood at the end of the stretches before.
    marks = both.groupBy(*on, "_chunk").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_v")))["_v"].alias("_last"))
    before = W.partitionBy(*on).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], F.col("_chunk").alias("_of"), "_carried")
    cond = F.col("_chunk") == F.col("_of")
    for i, k in enumerate(on):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    got = F.when(F.col("_at").isNotNull(), F.coalesce("_found", "_carried"))
    return found.join(carried.where("_carried IS NOT NULL"), cond, "left").select(*left.columns, *[got[v].alias(n) for v, n in names.items()])


def not_in(left: DataFrame, right: DataFrame, column: str, right_column: str) -> DataFrame:
    """``column NOT IN (SELECT right_column ...)``: null-aware anti join. A null on the right empties the result; a null on the
    left is kept only if the right side is empty."""
    keys = right.select(F.col(right_column).alias("_k"))
    facts = keys.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("_k").isNull()).alias("_nulls"))  # one row
    kept = left.join(keys.where("_k IS NOT NULL").distinct(), F.col(column) == F.col("_k"), "left_anti")
    kept = kept.join(F.broadcast(facts), (F.col("_nulls") == 0) & ((F.col("_rows") == 0) | F.col(column).isNotNull()))
    return kept.select(*left.columns)


def exists_flag(left: DataFrame, right: DataFrame, on: Sequence[str], name: str = "exists") -> DataFrame:
    """Existence join: every left row with whether the right side holds its key. The right side's keys are made distinct first."""
    keys = right.select(*[F.col(k).alias(f"_{k}") for k in on]).distinct().withColumn("_hit", F.lit(True))
    cond = None
    for k in on:
        e = F.col(k) == F.col(f"_{k}")
        cond = e if cond is None else cond & e
    return left.join(keys, cond, "left").select(*left.columns, F.coalesce("_hit", F.lit(False)).alias(name))
