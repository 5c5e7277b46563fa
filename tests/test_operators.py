from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, joins
from tessera.plans import join_order, rewrites


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture
def left(spark):
    return spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (3, None)], "k int, v string")


@pytest.fixture
def right(spark):
    return spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (None, "z")], "k int, v string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(left, right, how):
    got = joins.salted(left, right, "k", how, salts=3, hot_share=0.0)
    want = left.alias("l").join(right.select(F.col("k").alias("k_r"), F.col("v").alias("v_r")), F.col("l.k") == F.col("k_r"), how)
    assert got.columns == want.columns  # clashing names get a suffix
    assert values(got, *got.columns) == values(want, *want.columns)


def test_salted_join_of_nothing(spark, left, right):
    assert joins.salted(left.limit(0), right, "k").count() == 0
    assert joins.salted(left, right.limit(0), "k", "left").count() == 5


def test_lookup_broadcasts_only_what_is_small(left, right):
    assert "BroadcastHashJoin" in joins.lookup(left, right, ["k"])._jdf.queryExecution().toString()
    assert not joins.small_enough(right, 3)
    assert joins.lookup(left, right, ["k"], rows=3).count() == 4


def test_range_join_is_the_theta_join(spark):
    p = spark.createDataFrame([(i, i * 0.7) for i in range(-20, 60)] + [(None, 1.0)], "t int, x double")
    r = spark.createDataFrame([(-5, 3, "a"), (0, 30, "b"), (10, 10, "c"), (20, 12, "d"), (None, 5, "e"), (7, 8, "f")], "lo int, hi int, t string")
    got = joins.range_join(p, r, "t", "lo", "hi", 4)
    want = [(t, n) for t in range(-20, 60) for lo, hi, n in ((-5, 3, "a"), (0, 30, "b"), (7, 8, "f")) if lo <= t < hi]
    assert values(got, "t", "t_r") == sorted(want, key=str)


def test_asof_join(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    a = spark.createDataFrame([("u", t(5), 1), ("u", t(1), 2), ("w", t(9), 3), ("u", None, 4), (None, t(7), 5)], "u string, ts timestamp_ntz, id int")
    b = spark.createDataFrame([("u", t(2), "old"), ("u", t(5), "new"), ("u", t(6), "late"), (None, t(1), "none"), ("u", None, "never")], "u string, ts timestamp_ntz, id string")
    got = joins.asof_join(a, b, ["u"], "ts", values=["id"])
    assert values(got, "id", "id_r") == [(1, "new"), (2, None), (3, None), (4, None), (5, "none")]


def test_range_join_of_wide_ranges(spark):
    """Ranges a million times as long as the buckets are repeated three times at most."""
    p = spark.range(-50, 50).selectExpr("id * 100000 AS t", "id")
    r = spark.createDataFrame([(-10**9, 10**9, "all"), (0, 1, "point"), (-3_000_000, 2_000_001, "wide")], "lo long, hi long, n string")
    got = joins.range_join(p, r, "t", "lo", "hi", 1)
    want = [(i, n) for i in range(-50, 50) for lo, hi, n in ((-10**9, 10**9, "all"), (0, 1, "point"), (-3_000_000, 2_000_001, "wide")) if lo <= i * 100_000 < hi]
    assert values(got, "id", "n") == sorted(want, key=str)
    assert joins.range_join(p, r.limit(0), "t", "lo", "hi", 1).count() == 0


@pytest.mark.parametrize("chunks", [1, 3, 50])
def test_asof_join_by_brute_force(spark, chunks):
    """However time is cut, the latest right row is found, from stretches before as well."""
    rng = random.Random(chunks)
    some = lambda n, k: [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(0, 300, 7)]), k + i) for i in range(n)]
    a, b = some(200, 0), some(25, 1000)
    got = joins.asof_join(spark.createDataFrame(a, "u string, t int, id int"), spark.createDataFrame(b, "u string, t long, v int"), ["u"], "t", values=["v"], chunks=chunks)
    latest = lambda u, t: max(((x[1], x[2]) for x in b if x[0] == u and x[1] is not None and t is not None and x[1] <= t), default=(0, None))[1]
    assert values(got, "id", "v") == sorted([(i, latest(u, t)) for u, t, i in a], key=str)


def test_hot_key_is_spread_and_partitions_are_rebalanced(spark, tmp_path):
    x = spark.range(4000).selectExpr("1L AS k", "'same' AS v").repartition(8)
    out = joins.salted(x, spark.createDataFrame([(1, "r")], "k long, r string"), "k", salts=8).selectExpr("spark_partition_id() AS p", "r")
    assert out.count() == 4000
    from tessera.sources import files

    files.save(spark.range(1000).selectExpr("id", "IF(id < 900, 0, id) AS p"), str(tmp_path / "x"), partition_by=["p"])
    assert files.load(spark, str(tmp_path / "x")).count() == 1000


def test_lookup_of_few_but_wide_rows_is_no_broadcast(spark, left):
    wide = spark.range(3).selectExpr("CAST(id AS INT) AS k", "repeat('x', 1000) AS w")
    assert joins.small_enough(wide, 10, 10_000) and not joins.small_enough(wide, 10, 2_000)
    assert not joins.small_enough(wide, 2, 10_000)


def test_raise_error_raises(spark):
    with pytest.raises(Exception, match="negative"):
        spark.sql("SELECT raise_error('negative')").collect()


def test_not_in(spark, left, right):
    no_nulls = right.where("k IS NOT NULL")
    assert values(joins.not_in(left, no_nulls, "k", "k"), "k") == [(3,)]
    assert joins.not_in(left, right, "k", "k").count() == 0
    assert joins.not_in(left, right.limit(0), "k", "k").count() == 5


def test_existence(left, right):
    assert values(joins.exists_flag(left, right, ["k"]), "k", "exists") == [(1, True), (1, True), (2, True), (3, False), (None, False)]


def test_count_several_and_two_level(spark, left):
    assert left.agg(aggregates.count_all("k", "v").alias("n")).first().n == 3
    x = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 5)], "k string, v int")
    assert values(aggregates.two_level_sum(x, ["k"], "v"), "k", "total") == sorted([("a", 2), ("b", None), (None, 5)], key=str)


def test_multi_agg_keeps_every_filter(spark):
    x = spark.createDataFrame([(i, i % 3) for i in range(30)], "a int, b int")
    got = rewrites.multi_agg(x, {"n": (F.col("a") < 10, "count", F.lit(1)), "s": ((F.col("a") >= 5) & (F.col("b") == 1), "sum", F.col("a")), "d": (F.col("a") > 100, "count_distinct", F.col("b"))})
    assert tuple(got.first()) == (10, sum(i for i in range(5, 30) if i % 3 == 1), 0)
    assert str(got._jdf.queryExecution().optimizedPlan()).count("LogicalRDD") <= 1
    assert tuple(rewrites.multi_agg(x, {"n": (None, "count", F.lit(1)), "m": (F.col("a") < 3, "max", F.col("a"))}).first()) == (30, 2)


def test_rollup_from_finest_with_nulls(spark):
    x = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 3), (None, None, None), ("a", "x", 5)], "p string, q string, v int")
    got = rewrites.rollup_from_finest(x, ["p", "q"], {"s": ("sum", "v"), "n": ("count", "v"), "m": ("avg", "v"), "lo": ("min", "v")})
    want = x.rollup("p", "q").agg(F.grouping_id().alias("grouping_id"), F.sum("v").alias("s"), F.count("v").alias("n"), F.avg("v").alias("m"), F.min("v").alias("lo"))
    cols = ["p", "q", "grouping_id", "s", "n", "m", "lo"]
    assert values(got, *cols) == values(want, *cols)


def test_count_distinct_without_expand(spark):
    x = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", None, 4), ("b", None, None), (None, 7, 1)], "k string, c int, v int")
    got = rewrites.count_distinct_two_level(x, ["k"], "c", "d", ("s", "sum", "v"))
    assert values(got, "k", "d", "s") == sorted([("a", 1, 9), ("b", 0, None), (None, 1, 1)], key=str)
    assert "Expand" not in got._jdf.queryExecution().toString()


def test_self_join_rewrite_needs_two_different_values(spark):
    x = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (3, "a"), (None, "a"), (None, "b")], "k int, w string")
    assert values(rewrites.keys_with_several(x, "k", "w"), "k") == [(2,)]


def test_top_groups_keeps_ties_and_nulls(spark):
    x = spark.createDataFrame([(d, f) for d in (3, 1, 1, 2, None) for f in ("b", "a", None)], "d int, f string")
    got = rewrites.top_groups(x, ["d", "f"], [("d", True)], 4, F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in got.collect()] == [(None, None, 1), (None, "a", 1), (None, "b", 1), (1, None, 2)]
    with pytest.raises(ValueError):
        rewrites.top_groups(x, ["d"], [("f", True)], 4)


def test_date_range_reaches_the_scan(spark, duck):
    from comparing import DATA

    x = spark.read.parquet(f"{DATA}/lineitem.parquet").where(rewrites.in_year("l_shipdate", 1998))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_join_order_delays_products_and_starts_small(spark):
    t = lambda n, size, filtered=False: join_order.Relation(n, spark.createDataFrame([(1,)], f"{n} int"), filtered, size)
    c = lambda a, b, equi=True: join_order.Condition(a, b, F.col(a) == F.col(b), equi)
    rel = [t("fact", 1e9), t("dim", 1e6), t("tiny", 10, True), t("lone", 1)]
    plan = join_order.choose(rel, [c("fact", "dim"), c("fact", "tiny")])
    assert plan.order == ["tiny", "fact", "dim", "lone"]
    assert join_order.join(rel, [c("fact", "dim"), c("fact", "tiny")]).count() == 1
    two = [t("a", 1, True), t("b", 5), t("x", 2), t("y", 3)]
    out = join_order.join(two, [c("a", "b"), c("x", "y"), c("b", "y", False)])
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and out.count() == 1


def test_join_order_refuses_large_products(spark):
    rel = [join_order.Relation(n, spark.range(k).withColumnRenamed("id", n), size=k) for n, k in (("p", 5), ("q", 2000))]
    with pytest.raises(ValueError, match="nothing connects"):
        join_order.join(rel, [])


def test_top_per_group(spark):
    x = spark.createDataFrame([(1, 5), (1, 5), (1, 4), (1, 3), (2, 1)], "k int, v int")
    by = [F.col("v").desc()]
    assert [aggregates.top_per_group(x, ["k"], by, 2, t).count() for t in ("row_number", "rank", "dense_rank")] == [3, 3, 4]


def test_whole_tables_are_joined_and_sorted(spark, duck):
    from comparing import DATA

    from tessera.queries.catalog import QUERIES

    sales, stores = duck.execute("SELECT count(*), count(DISTINCT coalesce(ss_store_sk, -1)) FROM store_sales").fetchone()
    assert QUERIES["sort_nulls"](spark, DATA).count() == sales
    left = QUERIES["join_left"](spark, DATA)
    assert left.count() >= sales and left.selectExpr("coalesce(ss_store_sk, -1)").distinct().count() == stores


def test_whole_texts_and_vectors_are_exploded(spark, duck):
    from comparing import DATA

    from tessera.queries.catalog import QUERIES

    words = duck.execute("SELECT sum(len(string_split(text, ' '))) FROM documents").fetchone()[0]
    assert QUERIES["gen_explode"](spark, DATA).agg({"n": "sum"}).first()[0] == words
    assert QUERIES["gen_posexplode"](spark, DATA).count() == duck.execute("SELECT sum(len(embedding)) FROM embeddings").fetchone()[0]


def test_mathematics_takes_all_rows(spark, duck):
    from comparing import DATA

    from tessera.queries.catalog import QUERIES

    lines, sales = (duck.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("lineitem", "store_sales"))
    assert {QUERIES[q](spark, DATA).count() for q in ("fn_math_real", "fn_math_more")} == {lines}
    got = QUERIES["fn_try_arithmetic"](spark, DATA)
    assert got.count() == sales and got.where("m <= -4").count() > 0 and got.where("m <= -4 AND s IS NOT NULL").count() == 0


def test_bloom_filters(spark):
    from tessera.operators import filters

    big = spark.range(20_000).selectExpr("CAST(id AS INT) AS k", "id AS v").unionByName(spark.sql("SELECT CAST(NULL AS INT) AS k, 1L AS v"))
    few = spark.range(100).selectExpr("id * 7 AS k", "id AS w").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS k, 1L AS w"))
    made = few.where("k IS NOT NULL").selectExpr("CAST(k AS INT) AS k").agg(filters.bloom(few, ["k"], 100).alias("b")).first().b
    kept = big.where(filters.might_contain(big, made, ["k"]))
    assert kept.join(few.where("k IS NOT NULL"), "k", "left_semi").count() == 100 and kept.count() < 1_000
    got = filters.bloom_join(big, few, ["k"])
    assert values(got, "k", "v", "w") == values(big.join(few, "k"), "k", "v", "w") and "might_contain" in got._jdf.queryExecution().optimizedPlan().toString()
    assert filters.bloom_join(big, few.limit(0), ["k"], "left_semi").count() == 0


def test_runtime_bloom_filter_of_the_optimizer(spark, tmp_path):
    """With the session's settings Spark filters a large side by the small one's keys, once sizes call for it."""
    spark.range(50_000).selectExpr("id AS k", "id AS v").write.parquet(str(tmp_path / "big"))
    spark.range(5_000).selectExpr("id AS k2", "id % 10 AS w").write.parquet(str(tmp_path / "small"))
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        x = spark.read.parquet(str(tmp_path / "big")).join(spark.read.parquet(str(tmp_path / "small")).where("w = 3"), F.col("k") == F.col("k2"))
        assert "might_contain" in x._jdf.queryExecution().optimizedPlan().toString() and x.count() == 500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _metric(df, node, name):
    """A metric of the first plan node of a kind, after the frame was computed."""
    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        if "QueryStage" in p.getClass().getSimpleName():
            p = p.plan()
        if p.getClass().getSimpleName() == node:
            yield p.metrics().get(name).get().value()
        for i in range(p.children().size()):
            yield from walk(p.children().apply(i))

    return next(walk(df._jdf.queryExecution().executedPlan()))


def test_joins_and_aggregates_spill_and_fall_back(spark):
    """Beyond what memory is granted, a join's buffer goes to disk and a hash aggregate goes on as a sorting one; rows stay the same."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold": "5", "spark.sql.sortMergeJoinExec.buffer.spill.threshold": "10", "spark.sql.TungstenAggregate.testFallbackStartsAt": "2,3",
             "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "2"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        a, b = spark.range(60).selectExpr("id % 2 AS k", "id AS v"), spark.range(80).selectExpr("id % 2 AS k", "id AS w")
        joined = a.hint("merge").join(b, "k")
        assert len(joined.collect()) == 2 * 30 * 40 and _metric(joined, "SortMergeJoinExec", "spillSize") > 0
        g = spark.range(0, 1000, 1, 2).selectExpr("id % 100 AS k", "id AS v").groupBy("k").agg(F.sum("v").alias("s"))
        assert {(r.k, r.s) for r in g.collect()} == {(k, sum(range(k, 1000, 100))) for k in range(100)} and _metric(g, "HashAggregateExec", "numTasksFallBacked") > 0
        c = spark.range(0, 1000, 1, 2).selectExpr("id % 100 AS k", "id AS v").groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("l"))
        assert {(r.k, tuple(r.l)) for r in c.collect()} == {(k, tuple(range(k, 1000, 100))) for k in range(100)}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
