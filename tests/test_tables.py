from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.sources import files
from tessera.sources.tables import ConcurrentWrite, DuplicateMatch, Table
from tessera.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def t(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.create(spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (None, "c", 3.0), (4, "d", 4.0)], "k int, v string, x double"), ["k"])
    return t


def test_changes_and_versions(spark, t):
    t.insert(spark.createDataFrame([("e", 5)], "v string, k long"))
    t.update({"v": F.upper("v")}, "k >= 2")
    t.delete("x IS NULL AND k = 2")
    assert rows(t.read()) == sorted([(1, "a", 1.0), (None, "c", 3.0), (4, "D", 4.0), (5, "E", None)], key=str)
    assert [h[1] for h in t.history()] == ["create", "insert", "update", "delete"]
    assert t.read(0).count() == 4 and t.read(1).count() == 5
    t.optimize(["v"])
    assert t.vacuum() > 0 and t.versions() == [4] and t.read().count() == 4


def test_untouched_files_stay(spark, t):
    t.insert(t.read().limit(0).unionByName(spark.createDataFrame([(7, "q", 0.0)], "k int, v string, x double")))
    before = set(t._entry()["files"])
    t.update({"v": "'z'"}, "k = 4")
    after = set(t._entry()["files"])
    assert len(before) > 1 and before & after


def test_files_are_skipped_by_the_log(spark, tmp_path):
    t = Table(spark, str(tmp_path / "s"))
    some = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "CAST(id % 7 AS STRING) AS v", "date_add(DATE '2020-01-01', CAST(id AS INT)) AS d", "IF(id < 5, NULL, id * 0.5D) AS x")
    t.create(some(0, 100), ["id"])
    for lo in (100, 500, 800):
        t.insert(some(lo, {100: 500, 500: 800, 800: 1000}[lo]))
    files = t._entry()["files"]
    assert len(files) > 2 and sum(f["rows"] for f in files.values()) == 1000
    import datetime as dt

    for ranges, n in (({"id": (10, 20)}, 11), ({"d": (dt.date(2020, 1, 3), dt.date(2020, 1, 4))}, 2), ({"x": (2.0, 3.0)}, 2), ({"id": (None, 4), "x": (None, None)}, 5)):
        assert len(t.holding(files, ranges)) == 1 and t.read(ranges=ranges).count() == n
    assert t.read(ranges={"v": ("3", "3")}).count() == 143 and t.read(ranges={"id": (5000, None)}).count() == 0


def test_delta_log(spark, tmp_path):
    from tessera.sources import delta_log

    path = str(tmp_path / "d")
    x = spark.sql("SELECT id, IF(id % 4 = 0, NULL, concat('a b/', id % 4)) AS p, id * 0.5D AS v FROM range(40)")
    assert delta_log.write(x, path, ["p"]) == 0 and rows(delta_log.read(spark, path)) == rows(x)
    assert delta_log.write(spark.sql("SELECT 1.0D AS v, 'new' AS p, 100 AS id"), path) == 1
    assert delta_log.read(spark, path).count() == 41 and delta_log.read(spark, path, 0).count() == 40
    one = delta_log.read(spark, path).where("p = 'a b/1'")
    assert one.count() == 10 and "PartitionFilters: [isnotnull(p" in one._jdf.queryExecution().executedPlan().toString()
    delta_log.write(x.where("id < 8"), path, overwrite=True)
    assert rows(delta_log.read(spark, path)) == rows(x.where("id < 8")) and delta_log.read(spark, path, 1).count() == 41
    # A checkpoint stands for the commits before it.
    log = tmp_path / "d" / "_delta_log"
    files, schema, parts = delta_log._state(spark, path, None)
    kept = files.selectExpr("named_struct('path', path, 'deletionVector', CAST(NULL AS STRUCT<storageType: STRING>)) AS add")
    head = spark.read.json(str(log / f"{0:020d}.json")).where("metaData IS NOT NULL OR protocol IS NOT NULL").selectExpr("named_struct('minReaderVersion', 1, 'readerFeatures', CAST(NULL AS ARRAY<STRING>)) AS protocol",
        "IF(metaData IS NULL, NULL, named_struct('schemaString', metaData.schemaString, 'partitionColumns', metaData.partitionColumns, 'configuration', CAST(map() AS MAP<STRING, STRING>))) AS metaData")
    head.unionByName(kept, allowMissingColumns=True).coalesce(1).write.parquet(str(tmp_path / "c"))
    next((tmp_path / "c").glob("*.parquet")).rename(log / f"{2:020d}.checkpoint.parquet")
    for k in range(3):
        (log / f"{k:020d}.json").unlink()
    assert rows(delta_log.read(spark, path)) == rows(x.where("id < 8"))
    delta_log.write(x.where("id = 39"), path)
    assert delta_log.read(spark, path).count() == 9
    with pytest.raises(FileNotFoundError):
        delta_log.read(spark, path, 1)
    (log / f"{4:020d}.json").write_text('{"protocol": {"minReaderVersion": 3, "readerFeatures": ["deletionVectors"]}}')
    with pytest.raises(delta_log.Unsupported):
        delta_log.read(spark, path)


def test_hudi_timeline(spark, tmp_path):
    import json

    from tessera.sources import hudi_timeline

    root = tmp_path / "h"

    def base(part, group, at, ids):
        spark.createDataFrame([(at, i, f"{group}@{at}", part) for i in ids], "_hoodie_commit_time string, id int, v string, p string").coalesce(1).write.parquet(str(tmp_path / f"w-{part}-{group}-{at}"))
        (root / part).mkdir(parents=True, exist_ok=True)
        next((tmp_path / f"w-{part}-{group}-{at}").glob("*.parquet")).rename(root / part / f"{group}_0-1-2_{at}.parquet")

    def commit(at, kind="commit", **content):
        (root / ".hoodie" / f"{at}.{kind}").write_text(json.dumps(content))

    (root / ".hoodie").mkdir(parents=True)
    (root / ".hoodie" / "hoodie.properties").write_text("#x\nhoodie.table.type=COPY_ON_WRITE\nhoodie.table.version=6\n")
    t = [f"2024010{k}000000000" for k in range(1, 7)]
    base("p=1", "a_x", t[0], [1, 2])  # archived
    base("p=2", "b", t[1], [3])
    base("p=1", "a_x", t[2], [1, 2, 4])
    base("p=2", "c", t[3], [9])  # not completed
    base("p=2", "d", t[4], [3, 5])
    commit(t[1])
    commit(t[2])
    commit(t[3], "commit.inflight")
    commit(t[4], "replacecommit", partitionToReplaceFileIds={"p=2": ["b"]})
    at = lambda instant=None: sorted((r.id, r.v) for r in hudi_timeline.read(spark, str(root), instant).collect())
    assert at() == [(1, f"a_x@{t[2]}"), (2, f"a_x@{t[2]}"), (3, f"d@{t[4]}"), (4, f"a_x@{t[2]}"), (5, f"d@{t[4]}")]
    assert at(t[1]) == [(1, f"a_x@{t[0]}"), (2, f"a_x@{t[0]}"), (3, f"b@{t[1]}")] and at(t[2])[-1] == (4, f"a_x@{t[2]}")
    assert hudi_timeline.read(spark, str(root)).columns == ["id", "v", "p"]
    with pytest.raises(FileNotFoundError):
        at(t[3])
    commit(t[5], "deltacommit")
    with pytest.raises(hudi_timeline.Unsupported):
        at()


def test_data_source(spark, t):
    """The same rows as ``read``, as a batch scan that leaves out files by statistics."""
    from tessera.sources import table_source

    table_source.register(spark)
    for k in range(100, 112):
        t.insert(spark.createDataFrame([(k, "n", None)], "k int, v string, x double"))
    x = spark.read.format("tessera").load(t.path)
    assert rows(x) == rows(t.read()) and x.schema == t.read().schema
    assert rows(spark.read.format("tessera").option("version", 3).load(t.path)) == rows(t.read(3))
    one = x.where("k >= 105 AND k < 107")
    assert sorted(r.k for r in one.collect()) == [105, 106] and one.rdd.getNumPartitions() == 3  # 107 may be in the range that was pushed
    assert "BatchScan" in one._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW by_format USING tessera OPTIONS (path '{t.path}', version '0')")
    assert spark.table("by_format").count() == 4


def test_buckets_need_no_shuffle(spark, duck):
    from comparing import DATA

    from tessera.queries.catalog import QUERIES

    plan = QUERIES["agg_bucketed"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("HashAggregate") == 2
    assert "Exchange hashpartitioning" not in QUERIES["io_bucketed"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_column_indexes_skip_pages(spark, tmp_path):
    """Of a sorted row group only the pages that may hold the value are read."""
    x = spark.range(100_000).coalesce(1)
    x.write.option("parquet.page.row.count.limit", "1000").parquet(str(tmp_path / "pages"))
    y = spark.read.parquet(str(tmp_path / "pages")).where("id = 5")
    assert y.collect()[0].id == 5
    plan = y._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,5)]" in plan.toString()
    assert scan.metrics().get("numOutputRows").get().value() <= 2000


def test_many_versions_are_read_from_checkpoints(spark, tmp_path):
    t = Table(spark, str(tmp_path / "c"))
    t.create(spark.createDataFrame([(0,)], "k int"))
    for k in range(1, 13):
        t.insert(spark.createDataFrame([(k,)], "k int"))
    assert [t.read(v).count() for v in (0, 8, 9, 10, 12)] == [1, 9, 10, 11, 13]
    t.delete("k < 5")
    t.vacuum(keep=3)
    assert t.versions() == [11, 12, 13] and rows(t.read()) == sorted([(k,) for k in range(5, 13)], key=str)
    assert t.read(11).count() == 12 and not [f for f in (tmp_path / "c" / "_log").iterdir() if f.name.startswith("_")]


def test_merge(spark, t):
    s = spark.createDataFrame([(1, "A", 10.0), (4, "gone", 0.0), (None, "n", 1.0), (9, "new", 9.0)], "k int, v string, x double")
    t.merge(s, ["k"], delete_when="s.v = 'gone'")
    assert rows(t.read()) == sorted([(1, "A", 10.0), (2, "b", None), (None, "c", 3.0), (None, "n", 1.0), (9, "new", 9.0)], key=str)
    with pytest.raises(DuplicateMatch):
        t.merge(spark.createDataFrame([(1, "x", 0.0), (1, "y", 0.0)], "k int, v string, x double"), ["k"])


def test_statements(spark, t, tmp_path):
    from tessera.sources.statements import Statements

    s = Statements(spark, acc=t)
    s.run("UPDATE acc SET x = x + 1, v = concat(v, '!') WHERE k >= 2")
    s.run("INSERT INTO acc SELECT 7, 'g', 7.0D")
    s.run("DELETE FROM acc AS a WHERE a.x IS NULL")
    assert rows(s.run("SELECT * FROM acc")) == sorted([(1, "a", 1.0), (None, "c", 3.0), (4, "d!", 5.0), (7, "g", 7.0)], key=str)
    assert s.run("SELECT count(*) AS n FROM acc VERSION AS OF 0").first().n == 4 and s.run("SELECT a.v FROM acc VERSION AS OF 0 a JOIN acc b ON a.k = b.k WHERE a.k = 4").first().v == "d"
    s.run("""MERGE INTO acc AS tgt USING (SELECT explode(array(1, 4, 9)) AS k, 'm' AS v, CAST(NULL AS DOUBLE) AS x) AS src ON tgt.k = src.k
             WHEN MATCHED AND tgt.x > 4 THEN DELETE WHEN MATCHED THEN UPDATE SET v = concat(src.v, tgt.v) WHEN NOT MATCHED THEN INSERT (k, v) VALUES (src.k, 'new')""")
    assert rows(s.run("SELECT * FROM acc")) == sorted([(1, "ma", 1.0), (None, "c", 3.0), (7, "g", 7.0), (9, "new", None)], key=str)
    assert s.run("OPTIMIZE acc ORDER BY (x, v)").first().version == 5 and s.run("VACUUM acc RETAIN 2 VERSIONS").first().files_removed > 0
    for text in ("CACHE DATA SELECT v FROM acc WHERE k > 1 AFTER 5 CACHEPROPERTIES (a = 1)", "CACHE META DATA SELECT * FROM acc", "CACHE FILES SELECT v FROM acc"):
        assert s.run(text).first().started
    assert s.cached[0].columns == ["v"] and s.cached[1].columns == ["k", "v", "x"] and s.cached[0].is_cached
    s.release()
    with pytest.raises(ValueError):
        s.run("CACHE DATA SELECT v FROM acc AFTER 99")
    with pytest.raises(ValueError):
        s.run("UPDATE nowhere SET a = 1")
    s.run("INSERT OVERWRITE acc SELECT 1, 'only', 0.0D")
    assert rows(t.read()) == [(1, "only", 0.0)]


def test_empty_table_and_races(spark, tmp_path):
    t = Table(spark, str(tmp_path / "e"))
    empty = spark.createDataFrame([], "k int")
    t.create(empty)
    t.delete("k = 1")
    t.update({"k": "0"})
    assert t.read().count() == 0 and t.read().columns == ["k"]
    t.insert(spark.createDataFrame([(1,)], "k int"), overwrite=True)
    assert t.read().count() == 1
    other = Table(spark, t.path)
    other.versions = lambda: t.versions()[:-1]
    with pytest.raises(ConcurrentWrite):
        other._commit({}, {}, empty.schema, [], "late")
    with pytest.raises(FileExistsError):
        t.create(empty)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_round_trips_keep_nulls_and_empty_strings(spark, tmp_path, fmt):
    x = spark.createDataFrame([(1, "a\nb"), (2, ""), (3, None), (None, 'q"u,o')], "k int, v string")
    files.save(x, str(tmp_path / fmt), fmt)
    assert rows(files.load(spark, str(tmp_path / fmt), fmt, x.schema)) == rows(x)
    files.save(x.limit(0), str(tmp_path / f"{fmt}-none"), fmt)
    assert files.load(spark, str(tmp_path / f"{fmt}-none"), fmt, x.schema).count() == 0


def test_partitioned_write_prunes(spark, tmp_path):
    x = spark.range(1000).selectExpr("id", "id % 3 AS p")
    files.save(x, str(tmp_path / "p"), partition_by=["p"], sort_by=["id"])
    y = files.load(spark, str(tmp_path / "p")).where("p = 1")
    assert y.count() == 333 and "PartitionFilters: [isnotnull(p" in y._jdf.queryExecution().executedPlan().toString()
    assert files.has_format(spark, "orc") and not files.has_format(spark, "iceberg")


def test_stream_drops_late_rows_and_goes_on(spark, tmp_path):
    """A row whose window the watermark has passed before its batch began is dropped."""
    src = tmp_path / "in"
    one = lambda rows: spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(str(src))
    import datetime as dt
    import time

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(at(1), "a", 1.0), (at(1, 30), "a", 2.0), (None, "a", 9.0)], [(at(9), "a", 4.0)], [(at(9, 5), "a", 1.0)], [(at(1, 10), "a", 100.0), (at(12), "b", 1.0)]]
    for b in batches:
        one(b)
        time.sleep(1.1)  # files are taken in the order of their times
    like = spark.read.parquet(str(src))
    s = streams.read(spark, str(src), like, files_per_batch=1)
    out = streams.run_to_table(streams.tumbling(s, "ts", "1 hour", ["k"], F.sum("v").alias("v"), late="1 hour"), "append")
    got = {(r["window_start"].hour, r["k"]): r["v"] for r in out.collect()}
    assert got[1, "a"] == 3.0 and got[9, "a"] == 5.0 and (12, "b") not in got  # the last window isn't closed yet
