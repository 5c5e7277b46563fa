"""Problem 5: items of varying size into containers of fixed capacity.

The sizes of all items are counted in a global histogram with a fixed number of bins. Dynamic programming over it chooses the
bucket boundaries that minimise padding (the sum over all items of their bucket's upper bound minus their size). In every
group, batches are formed bucket by bucket, from the largest sizes to the smallest: a bucket's items first top up what larger
buckets left open (tightest fit first), then fill batches of their own up to the capacity. An item is only cut if it exceeds
the capacity, into the least number of pieces: all but the last fill a container each, the last is packed like an item.

Where a group then takes more containers than the sum of its sizes needs, its least filled containers (those that hold
``POOL`` items in all) are filled anew, each by the best of all subsets; that costs a group about a millisecond for each of them,
whatever its size. A group of more than about ``SHARD_ITEMS`` items is packed in parts of about that many, at a cost of less than
one container a part.

Defined cases: items without a positive size, or with a null size or identifier, are not packed; null groups are a group;
items of equal size are taken in the order of their identifiers; an empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.small_files import sharded
from ..scratch import written

#: Bins for each doubling of the size; sizes below 2**62 need 62 * BINS bins at most.
BINS = 16
BUCKETS = 16
SHARD_ITEMS = 50_000
#: Items that one task packs, on average.
TASK_ITEMS = 10_000
#: Items of the least filled containers for which a better filling is searched for among all subsets.
POOL = 24


def histogram(items: DataFrame, size: str) -> pd.DataFrame:
    """Counted sizes in logarithmic bins: at most 62 * BINS rows, whatever the data."""
    b = F.floor(F.log2(F.col(size)) * BINS)
    h = items.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(size).cast("double")).alias("total"), F.max(size).alias("upper"))
    return h.toPandas().sort_values("bin", ignore_index=True)


def boundaries(h: pd.DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding, ascending; the last is the largest size."""
    k = len(h)
    if not k:
        return []
    n = np.concatenate([[0.0], np.cumsum(h["n"].to_numpy(float))])
    upper = h["upper"].to_numpy(float)
    # best[j]: least of the summed upper bounds for the first j bins; the summed sizes are the same for every choice.
    best = np.concatenate([[0.0], np.full(k, np.inf)])
    came = []
    for _ in range(min(buckets, k)):
        cost = best[:, None] + (n[None, 1:] - n[:, None]) * upper[None, :]  # from i bins to j + 1 bins, bounded by bin j
        cost[np.arange(k + 1)[:, None] > np.arange(k)[None, :]] = np.inf
        frm = cost.argmin(0)
        new = np.concatenate([[0.0], cost[frm, np.arange(k)]])
        came.append(frm)
        best = new
    cuts, j = [], k
    for frm in reversed(came):
        if j <= 0:
            break
        cuts.append(int(h["upper"].iloc[j - 1]))
        j = int(frm[j - 1])
    return cuts[::-1]


def fill(sizes: np.ndarray, bounds: Sequence[int], capacity: int) -> np.ndarray:
    """Container numbers from 0 for sizes in descending order, none above the capacity."""
    bucket = np.searchsorted(np.asarray(bounds), sizes)
    out = np.empty(len(sizes), np.int64)
    open_: list[tuple[int, int]] = []  # (space left, container), ascending
    made = 0
    for b in range(int(bucket.max(initial=-1)), -1, -1):
        own: tuple[int, int] | None = None
        for i in np.flatnonzero(bucket == b).tolist():
            s = int(sizes[i])
            k = bisect_left(open_, (s, -1))
            if k < len(open_):  # the tightest space that larger buckets left
                left, c = open_.pop(k)
                out[i] = c
                if left > s:
                    insort(open_, (left - s, c))
                continue
            if own is None or own[0] < s:
                if own is not None and own[0]:
                    insort(open_, own)
                own = (capacity, made)
                made += 1
            out[i] = own[1]
            own = (own[0] - s, own[1])
        if own is not None and own[0]:
            insort(open_, own)
    return out


def _sums(sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all subsets, ascending, and which members each has (a bit each)."""
    total, members = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k, x in enumerate(sizes):
        total, members = np.concatenate([total, total + x]), np.concatenate([members, members | 1 << k])
        order = np.argsort(total, kind="stable")
        total, members = total[order], members[order]
    return total, members


def fullest(sizes: Sequence[int], space: int) -> list[int]:
    """Which sizes fill the space best: all subsets of one half are matched with those of the other."""
    half = len(sizes) // 2
    (a, in_a), (b, in_b) = _sums(sizes[:half]), _sums(sizes[half:])
    fits = a <= space
    a, in_a = a[fits], in_a[fits]
    at = np.searchsorted(b, space - a, "right") - 1
    k = int((a + b[at]).argmax())
    return [i for i in range(half) if in_a[k] >> i & 1] + [half + i for i in range(len(sizes) - half) if in_b[at[k]] >> i & 1]


def tighten(sizes: np.ndarray, numbers: np.ndarray, capacity: int) -> np.ndarray:
    """Container numbers for a group of sizes in descending order: if ``numbers`` take more containers than the sum needs, the least
    filled ones, with POOL items in all, are filled anew as well as any subset can; what takes fewer containers is kept."""
    used = int(numbers.max(initial=-1)) + 1
    if used <= -(-int(sizes.sum()) // capacity):
        return numbers
    load = np.zeros(used, np.int64)
    np.add.at(load, numbers, sizes)
    order = np.argsort(load, kind="stable")
    some = order[np.cumsum(np.bincount(numbers, minlength=used)[order]) <= POOL]
    if len(some) <= -(-int(load[some].sum()) // capacity):
        return numbers
    left, made = np.flatnonzero(np.isin(numbers, some)).tolist(), 0
    out = numbers.copy()
    while left and made < len(some):
        rest = left[1:]
        chosen = [left[0], *(rest[i] for i in fullest([int(sizes[r]) for r in rest], capacity - int(sizes[left[0]])))]
        out[chosen] = some[made]
        made += 1
        gone = set(chosen)
        left = [i for i in left if i not in gone]
    return np.unique(out, return_inverse=True)[1] if not left and made < len(some) else numbers


def pack(items: DataFrame, groups: Sequence[str], item: str, size: str, capacity: int) -> DataFrame:
    """Columns ``groups``, ``item``, piece_no (from 1), pieces (of the item), piece_size and container (unique in the group).
    ``items`` are computed once and written; histogram, number of rows and packing come from that table."""
    groups = list(groups)
    keys = [f"g{i}" for i in range(len(groups))]
    x = items.where((F.col(size) > 0) & F.col(item).isNotNull())
    x = x.select(*[F.col(g).cast("string").alias(k) for g, k in zip(groups, keys, strict=True)], F.col(item).alias("item"), F.col(size).cast("bigint").alias("size"))
    x = written(x, "items")
    rows = x.count()
    cap = F.lit(capacity).cast("bigint")
    pieces = F.expr(f"(size + {capacity - 1}L) div {capacity}L")
    x = x.withColumn("pieces", pieces).withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pieces"))))
    x = x.withColumn("piece_size", F.when(F.col("piece_no") < F.col("pieces"), cap).otherwise(F.col("size") - (F.col("pieces") - 1) * cap)).drop("size")
    full = x.where(F.col("piece_size") == cap).withColumn("container", F.concat_ws("-", F.lit("full"), F.col("item").cast("string"), F.col("piece_no").cast("string")))
    rest = x.where(F.col("piece_size") < cap)
    bounds = boundaries(histogram(rest, "piece_size"))
    rest = sharded(rest, keys, F.struct("item", "piece_no"), rows, SHARD_ITEMS)
    order = [*keys, "shard"]
    # An express number of tasks: rows of a few bytes that take Python's time to pack would otherwise be folded into few tasks.
    rest = rest.repartition(max(x.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ITEMS)), *order).sortWithinPartitions(*order, F.col("piece_size").desc(), "item", "piece_no")

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(g: pd.DataFrame) -> pd.DataFrame:
            sizes = g["piece_size"].to_numpy()
            c = tighten(sizes, fill(sizes, bounds, capacity), capacity)
            return g.assign(container=[f"{s}-{k}" for s, k in zip(g["shard"], c, strict=True)])

        waiting: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            b = pd.concat([*waiting, b], ignore_index=True) if waiting else b
            new = np.zeros(len(b), bool)
            for k in order:
                v = b[k].to_numpy()
                differs = v[1:] != v[:-1]
                if b[k].dtype == object:
                    none = b[k].isna().to_numpy()
                    differs &= ~(none[1:] & none[:-1])
                new[1:] |= differs
            at = [0, *np.flatnonzero(new).tolist(), len(b)]
            done = [packed(b.iloc[i:j]) for i, j in zip(at[:-2], at[1:-1], strict=True)]
            waiting = [b.iloc[at[-2] :]]  # its group may go on; a group has SHARD_ITEMS rows or so
            if done:
                yield pd.concat(done, ignore_index=True)
        if waiting:
            yield packed(waiting[0])

    schema = T.StructType([*rest.schema.fields, T.StructField("container", T.StringType())])
    out = rest.mapInPandas(go, schema).drop("shard").unionByName(full)
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], F.col("item").alias(item), "piece_no", "pieces", "piece_size", "container")
