"""Problem 3: distinct counts over huge identifier sets from mergeable, delta-coded runs of sorted 64-bit hashes.

A *run* is a sorted set of 64-bit hashes of one group: the first hash and then the differences, each in 7-bit groups of
bytes. Every input partition sorts and codes its own runs before the shuffle. Runs of the same group come to their task in the
order of their first hashes and are merged by a k-way union that gives out what no later run can add to, so a task holds the
runs that overlap at a time, not the group. Merged runs can be stored and merged again with those of other days, stores or groups
(``roll_up``). A group of more than ``SPLIT_ROWS`` rows is split by the leading bits of its hashes over tasks.

Counts are exact unless two identifiers share a hash. Among d identifiers the expected number of such pairs, and so the
expected undercount and the probability of any error, is at most d * (d - 1) / 2**65: ``error_bound`` reports it.

Defined cases: null identifiers don't count; null group values form a group of their own; an empty table gives no row;
repeated rows change nothing; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..parallel import spread

#: Hashes in one stored run at most; a larger set becomes several runs over disjoint ranges of hashes. An Arrow batch of 10,000
#: rows then has 80 MB at most.
MAX_RUN = 1024
#: Rows of a group above which its hashes are split by leading bits.
SPLIT_ROWS = 4_000_000
#: Groups that are split at most; only beyond SPLIT_ROWS times as many rows do tasks get larger shares.
SPLIT_GROUPS = 1_000_000
#: Hashes that a task codes or decodes at a time.
BUFFER = 1_000_000


def encode(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of sorted uint64 ``values``, coded anew at each index in ``starts``; the byte offset of every start, and the end."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    d = values.copy()
    d[1:] -= values[:-1]
    d[starts] = values[starts]
    sizes = np.ones(len(d), np.int64)
    for k in range(1, 10):
        sizes += d >= np.uint64(1) << np.uint64(7 * k)
    at = np.zeros(len(d) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    out = np.empty(at[-1], np.uint8)
    for k in range(int(sizes.max())):
        has = sizes > k
        part = (d[has] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F
        out[at[:-1][has] + k] = part | np.where(sizes[has] > k + 1, 0x80, 0).astype(np.uint8)
    return out, np.append(at[starts], at[-1])


def decode(data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values of runs that follow each other in ``data``; counts: values in each run, none 0."""
    if not len(data):
        return np.zeros(0, np.uint64)
    last = data < 0x80
    ends = np.flatnonzero(last)
    first = np.append(0, ends[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(first, ends - first + 1)
    d = np.add.reduceat((data & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), first)
    total = np.cumsum(d)  # wraps around, which the subtraction undoes
    starts = np.cumsum(counts) - counts
    return total - np.repeat(total[starts] - d[starts], counts)


_SIGN = np.uint64(1 << 63)


def _coded(keys: list[pa.Array], names: list[str], code: np.ndarray, prefix: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """Runs out of values sorted by (code, prefix, h) without repeats; keys: a row per code. ``first``: a run's first hash, as a
    bigint of the same order."""
    new = np.ones(len(h), bool)
    new[1:] = (code[1:] != code[:-1]) | (prefix[1:] != prefix[:-1])
    at = np.flatnonzero(new)
    inside = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    new |= inside % MAX_RUN == 0
    at = np.flatnonzero(new)
    data, offsets = encode(h, at)
    lengths = np.diff(np.append(at, len(h)))
    runs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    take = pa.array(code[at])
    cols = [*(k.take(take) for k in keys), pa.array(prefix[at].astype(np.int32)), pa.array((h[at] ^ _SIGN).view(np.int64)), pa.array(lengths.astype(np.int64)), runs]
    return pa.RecordBatch.from_arrays(cols, names=[*names, "prefix", "first", "n", "run"])


def _hashes(b: pa.RecordBatch, i: int, j: int) -> np.ndarray:
    """The hashes of rows i to j of a batch of runs."""
    if i >= j:
        return np.zeros(0, np.uint64)
    run, n = b.column("run"), b.column("n").to_numpy()
    off = np.frombuffer(run.buffers()[1], np.int32)[run.offset : run.offset + len(run) + 1]
    return decode(np.frombuffer(run.buffers()[2], np.uint8)[off[i] : off[j]], n[i:j])


def _slices(n: np.ndarray, i: int, j: int) -> Iterator[tuple[int, int]]:
    """Rows i to j in slices of BUFFER hashes or one row more."""
    part = np.cumsum(n[i:j]) // BUFFER
    at = [i, *(i + 1 + np.flatnonzero(part[1:] != part[:-1])).tolist(), j]
    yield from ((a, b) for a, b in zip(at, at[1:], strict=False) if a < b)


def _unique(code: np.ndarray, prefix: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o = np.lexsort((h, prefix, code))
    code, prefix, h = code[o], prefix[o], h[o]
    keep = np.ones(len(h), bool)
    keep[1:] = (code[1:] != code[:-1]) | (prefix[1:] != prefix[:-1]) | (h[1:] != h[:-1])
    return code[keep], prefix[keep], h[keep]


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
    """A number for each combination of values, and the columns' values by number; nulls are values."""
    n = len(columns[0]) if columns else 0
    code = np.zeros(n, np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    _, first = np.unique(code, return_index=True)
    return code, [c.take(pa.array(first)) for c in columns]


def _run_schema(schema: T.StructType, groups: Sequence[str]) -> T.StructType:
    return T.StructType([*(T.StructField(g, schema[g].dataType) for g in groups), T.StructField("prefix", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()), T.StructField("run", T.BinaryType())])


def _bits(df: DataFrame, groups: Sequence[str], weight: Column) -> dict[tuple, int]:
    """Leading bits by which each group of more than SPLIT_ROWS rows is split, out of one aggregate. There are at most as many
    such groups as SPLIT_ROWS goes into the rows: 250,000 (some 20 MB) at 10**12 rows; never more than SPLIT_GROUPS, as from
    there on the share of a task grows with the rows instead."""
    sizes = df.groupBy(*groups).agg(weight.cast("bigint").alias("_rows"))
    hot = F.collect_list(F.when(F.col("_rows") > SPLIT_ROWS, F.struct(*groups, "_rows")))
    got = sizes.agg(F.sum("_rows").alias("rows"), hot.alias("hot")).first()
    share = max(SPLIT_ROWS, (got["rows"] or 0) // SPLIT_GROUPS)
    return {tuple(r[g] for g in groups): int(np.ceil(np.log2(r["_rows"] / share))) for r in got["hot"] if r["_rows"] > share}


def _prefixes(code: np.ndarray, keys: list[pa.Array], h: np.ndarray, bits: dict[tuple, int]) -> np.ndarray:
    if not bits:
        return np.zeros(len(h), np.int64)
    by = np.array([bits.get(k, 0) for k in zip(*(c.to_pylist() for c in keys), strict=True)], np.int64)[code]
    return np.where(by > 0, (h >> (np.uint64(64) - np.maximum(by, 1).astype(np.uint64))).astype(np.int64), 0)


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays hold the same value; nulls are the same, and so are NaNs."""
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
    if pa.types.is_floating(a.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return same.to_numpy(zero_copy_only=False)


def union(batches: Iterable[pa.RecordBatch], groups: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """k-way union of runs that come sorted by ``groups``, prefix and first: what lies below the first hash of the key's next run
    is given out at once, so no more is held than the runs that overlap."""
    groups = list(groups)
    names = [*groups, "prefix"]
    key: pa.RecordBatch | None = None  # the key of the rows before, and those of its hashes that aren't given out yet
    pending = np.zeros(0, np.uint64)

    def out(keys: list[pa.Array], code: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        return _coded(keys[:-1], groups, code, keys[-1].to_numpy()[code], h)

    def several(b: pa.RecordBatch, i: int, j: int, starts: np.ndarray) -> pa.RecordBatch:
        """Whole groups, together."""
        code = np.repeat(np.cumsum(starts[i:j]) - 1, b.column("n").to_numpy()[i:j])
        keys = [b.column(k).take(pa.array(i + np.flatnonzero(starts[i:j]))) for k in names]
        code, _, h = _unique(code, np.zeros(len(code), np.int64), _hashes(b, i, j))
        return out(keys, code, h)

    def flush() -> Iterator[pa.RecordBatch]:
        if len(pending):
            yield out([key.column(k) for k in names], np.zeros(len(pending), np.int64), pending)

    for b in batches:
        if not b.num_rows:
            continue
        n, first = b.column("n").to_numpy(), b.column("first").to_numpy()
        starts = np.zeros(b.num_rows, bool)
        for k in names:
            c = b.column(k)
            starts[1:] |= ~_same(c.slice(1), c.slice(0, len(c) - 1))
        starts[0] = key is None or not all(_same(b.column(k).slice(0, 1), key.column(k))[0] for k in names)
        at = np.flatnonzero(starts)
        ends = np.append(at, b.num_rows)
        last = int(at[-1]) if len(at) else 0  # where the batch's last key begins, which may go on in the next one
        i = int(at[0]) if len(at) else b.num_rows
        long = [(0, i), *((int(x), int(y)) for x, y in zip(at, ends[1:], strict=True) if x == last or n[x:y].sum() > BUFFER)]
        done = 0
        for x, y in long:
            if x > done:  # the groups in between are whole and not large
                part = ends[(ends >= done) & (ends <= x)]
                size = np.array([n[p:q].sum() for p, q in zip(part, part[1:], strict=False)])
                cut = np.flatnonzero(np.diff(np.cumsum(size) // BUFFER)) + 1
                for p, q in zip([0, *cut], [*cut, len(size)], strict=True):
                    if p < q:
                        yield several(b, int(part[p]), int(part[q]), starts)
            done = y
            if x == y:
                continue
            if starts[x]:
                yield from flush()
                key, pending = b.slice(x, 1).select(names), np.zeros(0, np.uint64)
            for p, q in _slices(n, x, y):
                pending = np.union1d(pending, _hashes(b, p, q))
                # Later runs of the key begin at the next one's first hash or above.
                cut = int(np.searchsorted(pending, np.array(first[min(q, y - 1)], np.int64).view(np.uint64) ^ _SIGN))
                if cut >= MAX_RUN:
                    yield out([key.column(k) for k in names], np.zeros(cut, np.int64), pending[:cut])
                    pending = pending[cut:]
    yield from flush()


def _merged(runs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Union of the runs of each (group, prefix)."""
    groups = list(groups)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from union(batches, groups)

    return runs.repartition(*groups, "prefix").sortWithinPartitions(*groups, "prefix", "first").mapInArrow(go, runs.schema).drop("first")


def distinct_runs(df: DataFrame, groups: Sequence[str], identifier: str) -> DataFrame:
    """Merged runs per group: columns ``groups``, prefix, n, run. The runs of one group hold disjoint sets of hashes, so the
    sum of n is the group's count."""
    groups = list(groups)
    x = df.where(F.col(identifier).isNotNull())
    bits = _bits(x, groups, F.count(F.lit(1)))
    x = x.select(*groups, F.xxhash64(F.col(identifier)).alias("_h"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coded(bs: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(bs).combine_chunks()
            h = t.column("_h").to_numpy().view(np.uint64)
            cols = [t.column(g).combine_chunks() for g in groups]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            code, keys = _codes(cols) if groups else (np.zeros(len(h), np.int64), [])
            code, prefix, h = _unique(code, _prefixes(code, keys, h, bits), h)
            return _coded(keys, groups, code, prefix, h)

        waiting, rows = [], 0
        for b in batches:
            if b.num_rows:
                waiting.append(b)
                rows += b.num_rows
            if rows >= BUFFER:
                yield coded(waiting)
                waiting, rows = [], 0
        if waiting:
            yield coded(waiting)

    return _merged(spread(x).mapInArrow(go, _run_schema(df.schema, groups)), groups)


def roll_up(runs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Runs of coarser groups (some of the columns of ``runs``), by union of the finer ones; or of runs of other loads."""
    groups = list(groups)
    bits = _bits(runs, groups, F.sum("n"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_numpy()
            for i, j in _slices(n, 0, b.num_rows):
                h = _hashes(b, i, j)
                code, keys = _codes([b.column(g).slice(i, j - i) for g in groups])
                code = np.repeat(code, n[i:j])
                yield _coded(keys, groups, *_unique(code, _prefixes(code, keys, h, bits), h))

    return _merged(runs.select(*groups, "n", "run").mapInArrow(go, _run_schema(runs.schema, groups)), groups)


def counts(runs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Columns ``groups``, distinct_n, error_bound (expected undercount, see above)."""
    n = F.sum("n")
    return runs.groupBy(*groups).agg(n.alias("distinct_n"), (n.cast("double") * (n.cast("double") - 1) / F.lit(2.0**65)).alias("error_bound"))
