"""Percentiles, top N, distinct counts, packing and mixing against brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import distinct, mixing, packing, percentiles, top_n


# --- percentiles -------------------------------------------------------------------------------------------------------
def brute_percentiles(rows, pcts):
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    out = {}
    for g, v in by.items():
        v.sort()
        for p in pcts:
            need = max(1, math.ceil(p * len(v) / 100))
            at = (len(v) - 1) * p / 100
            lo = int(at)
            hi = min(lo + 1, len(v) - 1)
            out[g, p] = (len(v), v[need - 1], v[lo] + (v[hi] - v[lo]) * (at - lo))
    return out


def test_percentiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, 0.0, -0.0, 1.5, rng.gauss(0, 9)])) for _ in range(4000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame([(g, v, i, 0) for i, (g, v) in enumerate(rows)], "g string, x double, n int, pid int").repartition(7)
    pcts = (0, 25, 50, 90, 99.5, 100)
    got = {(r["g"], r["pct"]): (r["n"], r["at_least"], r["interpolated"]) for r in percentiles.percentiles(df, ["g"], ["x"], pcts).collect()}
    want = brute_percentiles(rows, pcts)
    assert set(got) == set(want)
    for k, (n, v, i) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(v) and got[k][2] == pytest.approx(i)


def test_days_are_combined_without_loss(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "id % 30 AS day", "CAST(pow(id % 101, 2) AS DECIMAL(9, 2)) AS x", "CAST(id % 7 AS INT) AS y")
    daily = percentiles.runs(df, ["g"], ["x", "y"], ["day"])
    apart = daily.where("day < 10").unionByName(daily.where("day >= 10"))
    cols = ["g", "measure", "pct", "n", "at_least", "interpolated", "rank_error"]
    a = percentiles.percentiles_from_runs(percentiles.merge_runs(apart, ["g"]), ["g"], (10, 50)).select(cols)
    b = percentiles.percentiles(df, ["g"], ["x", "y"], (10, 50)).select(cols)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 12


def test_percentiles_of_one_hot_value_and_of_nothing(spark):
    df = spark.range(5000).selectExpr("1 AS g", "IF(id < 4000, 5, id) AS x")
    r = percentiles.percentiles(df, ["g"], ["x"], (50,)).first()
    assert (r["at_least"], r["n"]) == (5, 5000)
    assert percentiles.percentiles(df.limit(0), ["g"], ["x"], (50,)).count() == 0


def test_percentiles_are_monotone_in_wide_partitions(spark):
    df = spark.range(200_000).selectExpr("id % 2 AS g", "xxhash64(id) AS x")
    got = percentiles.percentiles(df, ["g"], ["x"], (1, 50, 99)).collect()
    x = {g: np.sort(np.array([r[0] for r in df.where(f"g = {g}").select("x").collect()])) for g in (0, 1)}
    assert all(r["at_least"] == x[r["g"]][math.ceil(r["pct"] * 1000) - 1] for r in got) and len(got) == 6


# --- top N -------------------------------------------------------------------------------------------------------------
def test_top_n_with_ties_repeats_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(top_n, "BATCH_ROWS", 100)
    monkeypatch.setattr(top_n, "MAX_HEAP_ROWS", 50)
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(40)]), rng.choice([None, *range(10)])) for _ in range(3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g int, item int, score int, place int").repartition(5)
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s):
            best[g, i] = max(s, best.get((g, i), s))
    want = []
    for g in {k[0] for k in best}:
        want += [(g, i, -s, n + 1) for n, (s, i) in enumerate(sorted((-s, i) for (h, i), s in best.items() if h == g)[:7])]
    got = top_n.top_n(df, ["g"], "item", "score", 7)
    assert sorted(map(tuple, got.select("g", "item", "score", "place").collect())) == sorted(want)
    assert top_n.top_n(df.limit(0), ["g"], "item", "score", 7).count() == 0


def test_top_n_types_and_merging(spark):
    df = spark.createDataFrame([("a", "x", 1.5), ("a", "y", float("nan")), ("a", "z", 2.5), ("b", "x", None)], "g string, item string, s double")
    assert [tuple(r)[:3] for r in top_n.top_n(df, ["g"], "item", "s", 2).orderBy("place").collect()] == [("a", "z", 2.5), ("a", "x", 1.5)]
    d = spark.range(100).selectExpr("id % 4 AS g", "id AS item", "CAST(id AS DECIMAL(9, 2)) AS s")
    halves = top_n.heaps(d.where("item < 50"), ["g"], "item", "s", 3).unionByName(top_n.heaps(d.where("item >= 50"), ["g"], "item", "s", 3))
    a, b = top_n.merge_heaps(halves, ["g"], "item", "s", 3), top_n.top_n(d, ["g"], "item", "s", 3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and dict(b.dtypes)["s"] == "decimal(9,2)"


# --- distinct counts ---------------------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30, unique=True), min_size=1, max_size=5))
def test_runs_are_coded_without_loss(runs):
    v = np.concatenate([np.sort(np.array(r, np.uint64)) for r in runs])
    n = np.array([len(r) for r in runs])
    data, offsets = distinct.encode(v, np.cumsum(n) - n)
    assert offsets[-1] == len(data) and (distinct.decode(data, n) == v).all()


@pytest.mark.parametrize("split", [4_000_000, 50])
def test_distinct_counts_and_rolling_up(spark, monkeypatch, split):
    monkeypatch.setattr(distinct, "SPLIT_ROWS", split)
    monkeypatch.setattr(distinct, "BUFFER", 300)
    monkeypatch.setattr(distinct, "MAX_RUN", 16)
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), rng.choice(["hot"] * 4 + ["s", None]), rng.choice([None, *range(400)])) for _ in range(5000)]
    df = spark.createDataFrame([(*r, b"") for r in rows], "day int, store string, c long, run binary").repartition(6)
    runs = distinct.distinct_runs(df, ["day", "store"], "c")
    for by in (["day", "store"], ["day"], ["store"]):
        at = [["day", "store"].index(k) for k in by]
        want = defaultdict(set)
        for r in rows:
            if r[2] is not None:
                want[tuple(r[i] for i in at)].add(r[2])
        x = distinct.counts(runs if len(by) == 2 else distinct.roll_up(runs, by), by)
        got = {tuple(r[k] for k in by): (r["distinct_n"], r["error_bound"]) for r in x.collect()}
        assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
        assert all(e <= 1e-12 for _, e in got.values())
    assert distinct.distinct_runs(df.limit(0), ["day"], "c").count() == 0
    if split == 50:
        assert runs.where("prefix > 0").count() > 0


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_union_holds_only_runs_that_overlap(monkeypatch, rows):
    """One key of many runs among small keys, in batches of any size: the union is complete, ordered, and never held as a whole."""
    monkeypatch.setattr(distinct, "BUFFER", 500)
    monkeypatch.setattr(distinct, "MAX_RUN", 16)
    held, union1d = [0], np.union1d
    monkeypatch.setattr(np, "union1d", lambda a, b: held.append(len(a)) or union1d(a, b))
    rng = np.random.default_rng(4)
    want, made = {}, []
    for part in range(20):
        for g, n in (("a", 3), ("hot", 4000), ("hot2", 900), (None, 40), ("z", 1)):
            h = np.unique(rng.integers(0, 2**64, n, np.uint64) if g != "z" else np.array([5], np.uint64))
            want.setdefault(g, set()).update(h.tolist())
            made.append(distinct._coded([pa.array([g], pa.string())], ["g"], np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), h))
    t = pa.Table.from_batches(made).sort_by([("g", "ascending"), ("prefix", "ascending"), ("first", "ascending")]).combine_chunks()
    batch = t.to_batches()[0]
    got = {}
    for b in distinct.union([batch.slice(k, rows) for k in range(0, batch.num_rows, rows)], ["g"]):
        assert max(b.column("n").to_pylist()) <= 16
        for k, (g, n) in enumerate(zip(b.column("g").to_pylist(), b.column("n").to_pylist(), strict=True)):
            h = distinct._hashes(b, k, k + 1).tolist()
            assert len(h) == n and h == sorted(h) and (g not in got or got[g][-1] < h[0])
            got.setdefault(g, []).extend(h)
    assert {g: set(h) for g, h in got.items()} == want
    assert max(held) < 2000 < len(want["hot"])


# --- packing -----------------------------------------------------------------------------------------------------------
def test_boundaries_are_optimal():
    import itertools

    import pandas as pd

    rng = random.Random(1)
    for _ in range(20):
        k, b = rng.randint(1, 8), rng.randint(1, 4)
        upper = sorted(rng.sample(range(1, 100), k))
        n = [rng.randint(1, 9) for _ in upper]
        h = pd.DataFrame({"n": n, "upper": upper})
        cost = lambda cuts: sum(c * min(x for x in cuts if x >= u) for c, u in zip(n, upper, strict=True))  # noqa: B023, E731
        best = min(cost({*c, upper[-1]}) for m in range(min(b, k)) for c in itertools.combinations(upper[:-1], m))
        got = packing.boundaries(h, b)
        assert len(got) <= b and got[-1] == upper[-1] and cost(got) == best


def test_packing_holds_every_item_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 200)
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["p", None]), i, rng.choice([None, 0, -1, 100, 250, rng.randint(1, 99), rng.randint(1, 20)])) for i in range(2000)] + [("p", None, 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, id long, size long, container string")
    got = packing.pack(df, ["g"], "id", "size", 100).collect()
    whole = defaultdict(int)
    fill = defaultdict(int)
    for r in got:
        whole[r["id"]] += r["piece_size"]
        fill[r["g"], r["container"]] += r["piece_size"]
        assert r["pieces"] == math.ceil(rows[r["id"]][2] / 100) and 1 <= r["piece_no"] <= r["pieces"]
    assert whole == {i: s for _, i, s in rows if s and s > 0 and i is not None}
    assert max(fill.values()) <= 100
    for g in {r["g"] for r in got}:
        used = [f for (h, _), f in fill.items() if h == g]
        assert len(used) <= math.ceil(sum(used) / 100 * 1.05) + 8  # a container or so a part
    assert packing.pack(df.limit(0), ["g"], "id", "size", 100).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=11), st.integers(0, 120))
def test_fullest_is_the_best_subset(sizes, space):
    sums = {0}
    for s in sizes:
        sums |= {s + t for t in sums}
    got = packing.fullest(sizes, space)
    assert len(set(got)) == len(got) and sum(sizes[i] for i in got) == max(s for s in sums if s <= space)


def test_full_containers_are_found():
    rng = random.Random(6)
    for _ in range(20):
        sizes = []
        for _ in range(3):
            cuts = sorted(rng.sample(range(1, 10**8), 7))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 10**8], strict=True)]
        s = np.array(sorted(sizes, reverse=True))
        c = packing.tighten(s, packing.fill(s, [10**8], 10**8), 10**8)
        assert c.max() == 2 and (np.bincount(c, s) <= 10**8).all()


# --- mixing ------------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 300))
def test_knapsack_is_the_best(hist, budget):
    lengths, counts = [h[0] for h in hist], [h[1] for h in hist]
    take = mixing.knapsack(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
    sums = {0}
    for n, c in hist:
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert sum(t * n for t, n in zip(take, lengths, strict=True)) == max(s for s in sums if s <= budget)


def test_fit_reaches_wide_budgets():
    rng = random.Random(4)
    lengths = sorted(rng.sample(range(1, 3000), 400))
    counts = [rng.randint(1, 50) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    for budget in (1, total // 3, total - 1):
        take = mixing.fit(lengths, counts, budget)
        got = sum(a * b for a, b in zip(take, lengths, strict=True))
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and budget - lengths[0] <= got <= budget


def test_fit_of_long_documents():
    """Half the tokens of documents that are much longer than the least window: as near as the lengths allow."""
    lengths = list(range(200_000, 250_000, 1_000))
    budget = 3 * sum(lengths) // 2
    take = mixing.fit(lengths, [3] * 50, budget)
    assert all(0 <= t <= 3 for t in take) and budget - sum(a * b for a, b in zip(take, lengths, strict=True)) == budget % 1_000 == 500


def test_fit_of_very_many_lengths_needs_little_memory():
    import tracemalloc

    lengths = list(range(1, 10_001))
    tracemalloc.start()
    take = mixing.fit(lengths, [2] * 10_000, 31_234_567)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(a * b for a, b in zip(take, lengths, strict=True)) == 31_234_567 and peak < 30_000_000


@pytest.fixture(scope="module")
def docs(spark):
    text = lambda i: " ".join(["valve"] * (i % 13))
    rows = [(i, ["Big ", "big", " SMALL", "other", None][i % 5] if i % 50 else "small", text(i), 1) for i in range(1000)]
    return spark.createDataFrame([*rows, (5000, "small", None, 0)], "doc_id long, source string, text string, tokens int")


def test_mixture(spark, docs):
    targets = spark.createDataFrame([("big", 0.5, 2), ("Small", 0.5, 3), ("empty", 0.0, 1), ("nobody", 0.1, 4)], "source string, target_weight double, max_passes int")
    counted = mixing.count_documents(docs.drop("tokens"), targets)
    plan = mixing.plan(counted, targets)
    p = {r["source"]: r for r in plan.collect()}
    size = sum(len(r["text"].split()) for r in docs.collect() if r["text"] and (r["source"] or "").strip().lower() in ("big", "small"))
    small = sum(len(r["text"].split()) for r in docs.collect() if r["text"] and (r["source"] or "").strip().lower() == "small")
    assert p["Small"]["source_tokens"] == small and p["Small"]["goal"] == round(size / 2)
    assert p["Small"]["n_passes"] == min(3, math.ceil(size / 2 / small))
    assert (p["empty"]["n_passes"], p["empty"]["falls_short"]) == (0, 0) and (p["nobody"]["n_passes"], p["nobody"]["falls_short"]) == (4, 1)
    mix = mixing.select(counted, plan, seed=1).collect()
    for k in ("big", "small"):
        got = sum(r["tokens"] * r["passes"] for r in mix if r["key"] == k)
        want = min(round(size / 2), {"big": 2, "small": 3}[k] * p["big" if k == "big" else "Small"]["source_tokens"])
        assert want - 13 < got <= want
        assert max(r["passes"] for r in mix if r["key"] == k) <= {"big": 2, "small": 3}[k]
    again = mixing.select(counted, plan, seed=1).collect()
    assert sorted(map(tuple, mix)) == sorted(map(tuple, again)) and len({r["doc_id"] for r in mix}) == len(mix)


def test_token_counts_are_those_of_the_whole_text(spark, duck):
    texts = [r[0] for r in duck.execute("SELECT text FROM documents").fetchall()]
    texts += ["", None, "  ", "a\x1cb", "x y z", "naïve<|endoftext|> it's 'S ''re 12345 ÀÉ ﬁn", "長い文章。" * 300, "word " * 20000, "é e ́x"]
    c = mixing.Counter()
    assert c.count(texts) == [len(c.encoder.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
