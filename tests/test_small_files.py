from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import small_files
from tessera.sources import parquet_blocks as pb


def encoded(t: pa.Table, **options) -> bytes:
    out = io.BytesIO()
    pq.write_table(t, out, **options)
    return out.getvalue()


def joined(files: list[bytes]) -> tuple[bytes, dict]:
    out = io.BytesIO()
    got = pb.join_files([(io.BytesIO(f), len(f)) for f in files], out)
    return out.getvalue(), got


def tables(n: int = 3, rows: int = 500) -> list[pa.Table]:
    rng = np.random.default_rng(1)
    return [
        pa.table({"a": pa.array(rng.integers(0, 50, rows)), "s": pa.array([None if i % 7 == 0 else f"word {i % 20}" for i in range(rows)]), "l": pa.array([[i, None] if i % 3 else None for i in range(rows)])})
        for _ in range(n)
    ]


@pytest.mark.parametrize("options", [{}, {"compression": "zstd"}, {"use_dictionary": False}, {"write_page_index": True, "data_page_size": 256}, {"row_group_size": 100}, {"version": "1.0", "compression": "gzip"}])
def test_blocks_are_copied_and_rows_kept(options):
    ts = tables()
    data, got = joined([encoded(t, **options) for t in ts])
    assert pq.read_table(io.BytesIO(data)).equals(pa.concat_tables(ts))
    assert got["rows"] == 1500 and got["files"] == 3 and got["bytes"] == len(data)
    meta = pq.ParquetFile(io.BytesIO(data)).metadata
    assert meta.num_row_groups == got["row_groups"] == sum(pq.ParquetFile(io.BytesIO(encoded(t, **options))).metadata.num_row_groups for t in ts)
    if options.get("write_page_index"):
        assert meta.row_group(2).column(0).has_offset_index and meta.row_group(2).column(0).has_column_index


def test_joined_files_can_be_joined_again():
    ts = tables(4, 60)
    a, _ = joined([encoded(t, write_page_index=True) for t in ts[:2]])
    b, _ = joined([encoded(t, write_page_index=True) for t in ts[2:]])
    assert pq.read_table(io.BytesIO(joined([a, b])[0])).equals(pa.concat_tables(ts))


def test_empty_files_and_other_schemas():
    t = tables(1)[0]
    data, got = joined([encoded(t.slice(0, 0)), encoded(t)])
    assert got["rows"] == 500 and pq.read_table(io.BytesIO(data)).equals(t)
    with pytest.raises(pb.IncompatibleFiles):
        joined([encoded(t), encoded(t.select(["a", "s"]))])
    with pytest.raises(pb.IncompatibleFiles):
        joined([b"PAR1 nothing here"])
    with pytest.raises(pb.IncompatibleFiles):
        joined([])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.one_of(st.integers(-(2**63), 2**63 - 1), st.binary(max_size=20), st.booleans())), max_size=12, unique_by=lambda x: x[0]))
def test_footers_survive_reading_and_writing(fields):
    kinds = {int: pb.I64, bytes: pb.BINARY, bool: pb.TRUE}
    s = [[n, kinds[type(v)], v] for n, v in sorted(fields)]
    out = bytearray()
    pb.write_struct(out, s)
    back, end = pb.read_struct(memoryview(bytes(out)))
    assert end == len(out) and [(n, v) for n, _, v in back] == [(n, v) for n, _, v in s]


REPORT = "write_id long, table_path string, partition_id string, part_name string, record_count long, size_in_bytes long, extra int"


def test_spellings_of_one_file(spark):
    same = [
        (1, "/L/t", "a=1/b=2", "x_1"), (2, "file:/L/t/", "./a=1/b=2/", " X_1"), (3, "/L//t", "a%3D1/b%3D2", "./x_1"), (4, "/l/t", "a=1//b=2", "a=1/b=2/x_1"), (5, "file:///L/t", "a=1/b=2", "x_1/"),
        (6, "/L/t", "a=1/b=3", "x_1"), (7, "/L/t", None, "x_1"), (8, "/L/t", "__NO_PARTITION_ID__/", "__NO_PARTITION_ID__/x_1"), (9, None, "p", "x"), (10, "/L/t", "p", None),
    ]
    r = spark.createDataFrame([(*x, 5, None if x[0] in (1, 3) else -1 if x[0] == 2 else 100, 0) for x in same], REPORT)
    got = sorted(tuple(x) for x in small_files.files(r).select("write_id", "bytes", "records").collect())
    assert got == [(1, 100, 5), (6, 100, 5), (7, 100, 5)]


def test_plan_takes_each_small_file_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "t", "hot" if i % 3 else f"p{i % 50}", 1, int(rng.integers(1, 1000))) for i in range(3000)]
    rows += [(5000, "t", "alone", 1, 5), (5001, "t", "p1", 0, 5), (5002, "t", "p1", 1, None), (5003, "t", "big", 1, 10**9), (5004, "t", "big", 1, 5)]
    f = spark.createDataFrame(rows, "write_id long, table string, partition string, records long, bytes long")
    p = small_files.plan(f, small=1000, target=10_000).toPandas()
    assert sorted(p["write_id"]) == [r[0] for r in rows[:3000]]
    per = p.groupby(["table", "partition", "output"])["bytes"].agg(["sum", "count"])
    assert (per["count"] >= 2).all() and (per["sum"] < 16_000).all()
    assert (per[per["sum"] < 5000].reset_index()["partition"] != "hot").all()
    assert small_files.plan(f.limit(0)).count() == 0
    more = f.selectExpr("*", "'x' AS output", "1 AS _bytes", "'y' AS name").limit(50)
    assert set(small_files.plan(more).columns) == {*f.columns, "name", "output"}


def test_hot_partitions_are_split(spark):
    f = spark.range(1000).selectExpr("id AS write_id", "IF(id < 900, 'hot', CAST(id AS STRING)) AS p")
    s = small_files.sharded(f, ["p"], f["write_id"], 1000, shard_rows=100)
    per = {(r["p"], r["shard"]): r["count"] for r in s.groupBy("p", "shard").count().collect()}
    assert sum(per.values()) == 1000 and max(per.values()) <= 100 + 60 and sum(p == "hot" for p, _ in per) >= 8
    assert all(k == 0 for p, k in per if p != "hot")


def test_plan_is_the_same_however_files_are_dealt_out(spark, monkeypatch):
    """The outputs of a hot partition stay of even size when its files lie in many buckets."""
    f = spark.range(4000).selectExpr("id AS write_id", "'t' AS table", "IF(id < 3000, 'hot', CAST(id % 100 AS STRING)) AS partition", "1L AS records", "1 + id % 97 AS bytes")
    monkeypatch.setattr(small_files, "SHARD_FILES", 50)
    p = small_files.plan(f, small=1000, target=5_000).toPandas()
    per = p.groupby(["partition", "output"])["bytes"].agg(["sum", "count"]).reset_index()
    assert len(p) == 4000 and p["write_id"].is_unique and (per["count"] >= 2).all()
    hot = per[per["partition"] == "hot"]["sum"]
    assert len(hot) == round(sum(1 + i % 97 for i in range(3000)) / 5_000) and hot.min() > 4_500 and hot.max() < 5_500


def test_copying_is_dealt_out_over_tasks(spark, tmp_path):
    """Many small files: their outputs are written by many tasks, not by one that adaptive execution folded them into."""
    src, one = tmp_path / "src", encoded(pa.table({"a": pa.array(range(10))}))
    for k in range(2000):
        (src / f"p={k % 11}").mkdir(parents=True, exist_ok=True)
        (src / f"p={k % 11}" / f"f{k}.parquet").write_bytes(one)
    made = small_files.compact(spark, str(src), str(tmp_path / "out")).toPandas()
    assert len(made) == 11 and made["files"].sum() == 2000 and made["rows"].sum() == 20_000
    assert made["task"].nunique() >= 6


def test_listing(spark, tmp_path):
    for n in ("a.parquet", "x/b c%3D.parquet", "x/_hidden/c.parquet", "x/_SUCCESS", "x/.d.parquet", "x/_k=1/e.parquet", "y/z/f.parquet", "y/g.csv"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"12345")
    got = sorted(tuple(r) for r in small_files.listing(spark, f"file:{tmp_path}").collect())
    assert got == [("", "a.parquet", 5), ("x", "b c%3D.parquet", 5), ("x/_k=1", "e.parquet", 5), ("y/z", "f.parquet", 5)]
    (tmp_path / "none").mkdir()
    assert small_files.compact(spark, str(tmp_path / "none"), str(tmp_path / "out")).count() == 0


def test_files_that_readers_take_differently_stay_apart(spark, tmp_path):
    """A file marked for the old calendar isn't joined with others; keys that say nothing about values don't matter."""
    t = pa.table({"a": pa.array([1, 2])})
    mark = lambda **kv: encoded(t.replace_schema_metadata(kv))
    old, plain, other = mark(**{"org.apache.spark.legacyDateTime": "", "x": "1"}), mark(x="1"), mark(x="1", y="2")
    with pytest.raises(pb.IncompatibleFiles):
        joined([plain, old])
    data, _ = joined([plain, plain])
    assert pq.ParquetFile(io.BytesIO(data)).metadata.metadata[b"x"] == b"1"
    (tmp_path / "src").mkdir()
    for k, f in enumerate([old, plain, old, plain]):
        (tmp_path / "src" / f"{k}.parquet").write_bytes(f)
    small_files.compact(spark, str(tmp_path / "src"), str(tmp_path / "out")).collect()
    marks = sorted(b"org.apache.spark.legacyDateTime" in pq.ParquetFile(f).metadata.metadata for f in (tmp_path / "out").glob("*.parquet"))
    assert marks == [False, True]
    with pytest.raises(pb.IncompatibleFiles):  # pyarrow's own schema key differs, too
        joined([plain, other])


def test_directory_is_compacted_without_loss(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    x = spark.range(5000).selectExpr("id", "id % 4 AS p", "CAST(id AS STRING) AS s", "IF(id % 5 = 0, NULL, id * 0.5D) AS d")
    x.repartition(6).write.partitionBy("p").parquet(str(src))
    made = small_files.compact(spark, str(src), str(out), target=1 << 20).collect()
    assert sum(r["rows"] for r in made) == 5000 and len(made) == 4 and sum(r["files"] for r in made) == len(list(src.rglob("*.parquet")))
    back = spark.read.schema("id long, s string, d double, p int").parquet(str(out))
    assert back.count() == 5000 and back.selectExpr("id", "CAST(p AS BIGINT) AS p", "s", "CAST(d AS DOUBLE) AS d").exceptAll(x.selectExpr("id", "p", "s", "CAST(d AS DOUBLE) AS d")).count() == 0
    assert len(list(out.rglob("*.parquet"))) == 4


def test_returns_are_compacted_whole(spark, tmp_path, monkeypatch):
    """Small files grow in number with the input's, and the rows without a day are joined with the rest."""
    from comparing import DATA

    from tessera.queries import storage

    spark.read.parquet(f"{DATA}/store_returns.parquet").selectExpr("*", "explode(sequence(1, 40)) AS i").drop("i").repartition(8).write.parquet(str(tmp_path / "store_returns.parquet"))
    r = spark.read.parquet(str(tmp_path / "store_returns.parquet"))
    made = []
    compact = small_files.compact
    monkeypatch.setattr(small_files, "compact", lambda *a: made.append(compact(*a).toPandas()) or spark.createDataFrame(made[0]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = storage.p4_returns_compacted(spark, str(tmp_path)).agg({"n": "sum"}).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    days = r.where("sr_returned_date_sk IS NOT NULL").count()
    assert days < made[0]["rows"].sum() == r.count() and got == days
    assert made[0]["files"].max() > 4
