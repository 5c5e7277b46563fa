"""Sources, sinks, table changes, streams and user-defined functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..scratch import new_path
from ..sources import delta_log, files, table_source, tables
from ..sources.statements import Statements
from ..streaming import streams
from .registry import query, table

# --- formats -----------------------------------------------------------------------------------------------------------
for _fmt in ("parquet", "orc", "csv", "json", "xml"):

    def _round_trip(spark: SparkSession, d: str, fmt: str = _fmt) -> DataFrame:
        x = table(spark, d, "orders")
        path = new_path(spark, f"orders-{fmt}")
        files.save(x, path, fmt)
        return files.load(spark, path, fmt, x.schema)

    query("SELECT * FROM orders", f"io_{_fmt}")(_round_trip)


@query("SELECT n_name AS value FROM nation")
def io_text(spark: SparkSession, d: str) -> DataFrame:
    """Text lines."""
    path = new_path(spark, "text")
    files.save(table(spark, d, "nation").select(F.col("n_name").alias("value")), path, "text")
    return files.load(spark, path, "text")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def io_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Partitioned write; the filter prunes folders."""
    path = new_path(spark, "partitioned")
    files.save(table(spark, d, "orders"), path, partition_by=["o_orderstatus"], sort_by=["o_orderdate"])
    return files.load(spark, path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def io_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Bucketed tables joined without a shuffle."""
    made = [files.bucketed(table(spark, d, n), new_path(spark, f"bucketed-{n}"), [k], 8) for n, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))]
    return made[0].join(made[1], F.col("o_orderkey") == F.col("l_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def agg_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate by the buckets' column: both of its steps in one stage, without a shuffle."""
    x = files.bucketed(table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), new_path(spark, "bucketed-lines"), ["l_orderkey"], 8)
    return x.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT count(*) AS n, true AS named, true AS sized FROM nation")
def io_file_facts(spark: SparkSession, d: str) -> DataFrame:
    """Hidden columns of a file scan."""
    x = files.with_file_facts(table(spark, d, "nation"))
    return x.agg(F.count(F.lit(1)).alias("n"), (F.min(F.length("file_path")) > 0).alias("named"), (F.min("file_size") > 0).alias("sized"))


@query("SELECT count(*) AS n, max(l_extendedprice) AS hi FROM lineitem WHERE l_returnflag = 'R'")
def io_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cached selection."""
    x = files.cache_data(table(spark, d, "lineitem"), ["l_extendedprice", "l_returnflag"], "l_returnflag = 'R'")
    return x.agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("hi"))


@query("SELECT k, v FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v)")
def io_create_insert_sql(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE, INSERT INTO and INSERT OVERWRITE in SQL."""
    path, name = new_path(spark, "sql-table"), f"tessera_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (k INT, v STRING) USING parquet LOCATION '{path}'")
    spark.sql(f"INSERT INTO {name} VALUES (9, 'z')")
    spark.sql(f"INSERT OVERWRITE {name} VALUES (1, 'a')")
    spark.sql(f"INSERT INTO {name} VALUES (2, 'b')")
    return spark.table(name)


@query("SELECT o_orderpriority, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE count(*) END AS n FROM orders GROUP BY 1")
def io_dynamic_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Overwriting only the partitions that are written."""
    path = new_path(spark, "dynamic")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    o.write.partitionBy("o_orderpriority").parquet(path)
    one = o.where("o_orderpriority = '3-MEDIUM'").agg(F.min("o_orderkey").alias("o_orderkey"), F.first("o_orderpriority").alias("o_orderpriority"))
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("o_orderpriority").parquet(path)
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_state, count(*) AS n FROM store_sales JOIN store ON ss_store_sk = s_store_sk WHERE s_number_employees > 250 GROUP BY 1")
def io_dynamic_pruning(spark: SparkSession, d: str) -> DataFrame:
    """A join whose filtered side prunes the other's partitions at run time."""
    path = new_path(spark, "pruned")
    s = table(spark, d, "store_sales").select("ss_item_sk", "ss_store_sk")
    files.save(s.where("ss_store_sk IS NOT NULL"), path, partition_by=["ss_store_sk"])
    big = table(spark, d, "store").where("s_number_employees > 250")
    return files.load(spark, path, schema="ss_item_sk bigint, ss_store_sk bigint").join(big, F.col("ss_store_sk") == F.col("s_store_sk")).groupBy("s_state").agg(F.count(F.lit(1)).alias("n"))


# --- changes -----------------------------------------------------------------------------------------------------------
def _table(spark: SparkSession, d: str) -> tables.Table:
    t = tables.Table(spark, new_path(spark, "customers"))
    t.create(table(spark, d, "customer"), ["c_custkey"])
    return t


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    """UPDATE."""
    t = _table(spark, d)
    t.update({"c_acctbal": F.col("c_acctbal") + 100}, "c_mktsegment = 'BUILDING'")
    return t.read()


@query("SELECT * FROM customer WHERE NOT (c_custkey < 100 OR c_acctbal < 0)")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    """DELETE."""
    t = _table(spark, d)
    t.delete("c_custkey < 100 OR c_acctbal < 0")
    return t.read()


@query("""
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 1 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 2
UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 3""")
def dml_merge(spark: SparkSession, d: str) -> DataFrame:
    """MERGE: update, delete and insert."""
    t = _table(spark, d)
    c = table(spark, d, "customer")
    s = c.where("c_custkey % 10 IN (1, 2)").withColumn("gone", F.col("c_custkey") % 10 == 2)
    s = s.unionByName(c.where("c_custkey % 10 = 3").withColumn("c_custkey", F.col("c_custkey") + 10_000_000).withColumn("gone", F.lit(False)))
    t.merge(s, ["c_custkey"], update={"c_acctbal": F.lit(0.0)}, delete_when="s.gone")
    return t.read()


@query("SELECT *, 2 AS versions FROM customer")
def dml_optimize_vacuum(spark: SparkSession, d: str) -> DataFrame:
    """OPTIMIZE by another order, VACUUM."""
    t = _table(spark, d)
    t.insert(table(spark, d, "customer").limit(0))
    t.optimize(["c_nationkey"])
    t.vacuum(keep=2)
    return t.read().withColumn("versions", F.lit(len(t.versions())))


@query("SELECT * FROM customer")
def dml_time_travel(spark: SparkSession, d: str) -> DataFrame:
    """An earlier version."""
    t = _table(spark, d)
    t.delete("true")
    return t.read(0)


@query("""
SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 3
UNION ALL SELECT c_custkey + 10000000, 'new', c_nationkey, NULL, NULL FROM customer WHERE c_custkey % 10 = 4""")
def dml_statements(spark: SparkSession, d: str) -> DataFrame:
    """UPDATE, DELETE, MERGE and OPTIMIZE as SQL."""
    s = Statements(spark, customers=_table(spark, d))
    source = s._view(table(spark, d, "customer").where("c_custkey % 10 = 4").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    s.run("UPDATE customers SET c_name = upper(c_name)")
    s.run("DELETE FROM customers WHERE c_custkey % 10 = 3")
    s.run(f"MERGE INTO customers t USING {source} s ON t.c_custkey = s.c_custkey WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (c_custkey, c_name, c_nationkey) VALUES (s.c_custkey, 'new', s.c_nationkey)")
    s.run("OPTIMIZE customers ORDER BY (c_nationkey)")
    return s.run("SELECT * FROM customers VERSION AS OF 3")


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def dml_skipped_files(spark: SparkSession, d: str) -> DataFrame:
    """Files left out by the log's statistics."""
    t = tables.Table(spark, new_path(spark, "orders"))
    o = table(spark, d, "orders")
    t.create(o.where("o_orderkey < 500"), ["o_orderkey"])
    t.insert(o.where("o_orderkey >= 500"))
    return t.read(ranges={"o_orderkey": (100, 900)})


@query("SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'")
def io_delta_log(spark: SparkSession, d: str) -> DataFrame:
    """A table in the Delta format: written, appended to, and an earlier version read."""
    path, c = new_path(spark, "delta"), table(spark, d, "customer")
    delta_log.write(c.where("c_mktsegment = 'MACHINERY'"), path, ["c_mktsegment"])
    delta_log.write(c.where("c_mktsegment NOT IN ('MACHINERY', 'BUILDING')"), path)
    delta_log.write(c.where("c_mktsegment = 'BUILDING'"), path, overwrite=True)
    return delta_log.read(spark, path, 1)


@query("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_custkey >= 100 GROUP BY 1")
def io_data_source(spark: SparkSession, d: str) -> DataFrame:
    """A versioned table through the data source interface (a batch scan)."""
    table_source.register(spark)
    t = _table(spark, d)
    x = spark.read.format("tessera").load(t.path).where("c_custkey >= 100")
    return x.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


# --- streams -----------------------------------------------------------------------------------------------------------
def _events(spark: SparkSession, d: str) -> DataFrame:
    like = table(spark, d, "events")
    s = streams.read(spark, f"{d}/events.parquet", like)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of a stream."""
    x = streams.tumbling(_events(spark, d), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = streams.run_to_table(x, "complete", "tumbling")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
SELECT w AS window_start, count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events) t GROUP BY 1""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of an hour every half hour."""
    x = streams.sliding(_events(spark, d), "ts", "1 hour", "30 minutes", [], F.count(F.lit(1)).alias("n"))
    return streams.run_to_table(x, "complete", "sliding").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '{0}' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '{0}' AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""


@query(_SESSIONS.format("2 hours"))
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a stream."""
    x = streams.sessions(_events(spark, d), "ts", "2 hours", ["user_id"], F.count(F.lit(1)).alias("n"))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return streams.run_to_table(x, "complete", "sessions").select("user_id", ntz("session_start"), ntz("session_end"), "n")


@query(_SESSIONS.format("2 hours"))
def batch_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The same sessions of a batch."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return streams.sessions(e, "ts", "2 hours", ["user_id"], F.count(F.lit(1)).alias("n")).select("user_id", ntz("session_start"), ntz("session_end"), "n")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def batch_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a batch."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.tumbling(e, "ts", "10 minutes", [], F.count(F.lit(1)).alias("n")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_without_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """First rows of keys in a stream."""
    x = streams.without_duplicates(_events(spark, d), "ts", ["user_id", "event_type"], late="400 days")
    return streams.run_to_table(x.select("user_id", "event_type"), "append", "first").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, event_id, user_id, value FROM events")
def stream_file_sink(spark: SparkSession, d: str) -> DataFrame:
    """A stream into partitioned files, and what they hold."""
    out = streams.run_to_files(_events(spark, d).select("event_type", "event_id", "user_id", "value"), partition_by=["event_type"])
    return spark.read.parquet(out).select("event_type", "event_id", "user_id", "value")


@query("SELECT user_id, count(*) AS n, round(coalesce(sum(value), 0), 2) AS total FROM events GROUP BY 1")
def stream_running_totals(spark: SparkSession, d: str) -> DataFrame:
    """State of one's own."""
    x = streams.run_to_table(streams.running_totals(_events(spark, d), "user_id", "value"), "update", "totals")
    return x.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "batch"), 2).alias("total"))


# --- functions of one's own --------------------------------------------------------------------------------------------
@query("SELECT p_partkey, substring(p_name, 1, 1) || substring(split_part(p_name, ' ', 2), 1, 1) AS i FROM part")
def udf_row(spark: SparkSession, d: str) -> DataFrame:
    """Row at a time."""
    return table(spark, d, "part").select("p_partkey", udfs.initials("p_name").alias("i"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 5) AS p FROM lineitem")
def udf_batch(spark: SparkSession, d: str) -> DataFrame:
    """Arrow batches."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(udfs.discounted("l_extendedprice", "l_discount"), 5).alias("p"))


@query("SELECT p_partkey, round(sqrt(p_size), 6) AS w FROM part")
def udf_iterator(spark: SparkSession, d: str) -> DataFrame:
    """Iterator of batches."""
    return table(spark, d, "part").select("p_partkey", F.round(udfs.scaled("p_size"), 6).alias("w"))


@query("SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS g FROM part GROUP BY 1")
def udf_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Aggregate function."""
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(udfs.geometric_mean("p_retailprice"), 4).alias("g"))


@query("SELECT p_brand, substring(p_name, 1, 1) || substring(split_part(p_name, ' ', 2), 1, 1) AS i, round(exp(avg(ln(p_retailprice))), 4) AS g FROM part GROUP BY 1, 2")
def udf_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """Registered functions."""
    udfs.registered(spark)
    x = spark.sql("SELECT p_brand, initials(p_name) AS i, p_retailprice FROM {part}", part=table(spark, d, "part"))
    return spark.sql("SELECT p_brand, i, round(geometric_mean(p_retailprice), 4) AS g FROM {x} GROUP BY p_brand, i", x=x)


@query("SELECT p_partkey, w AS word, CAST(k - 1 AS INT) AS position FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part) t")
def udf_table(spark: SparkSession, d: str) -> DataFrame:
    """Table function."""
    spark.udtf.register("tessera_words", udfs.Words)
    return spark.sql("SELECT p_partkey, w.word, w.position FROM {part}, LATERAL tessera_words(p_name) w", part=table(spark, d, "part"))


@query("SELECT c_custkey, c_mktsegment, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS c_acctbal FROM customer")
def udf_group_map(spark: SparkSession, d: str) -> DataFrame:
    """Group map."""
    x = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return udfs.normalised(x, "c_mktsegment", "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("SELECT n_nationkey, n_name, upper(n_name) AS u FROM nation")
def udf_arrow_map(spark: SparkSession, d: str) -> DataFrame:
    """Arrow map."""
    return udfs.batch_map(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", "u")


@query("SELECT n_regionkey, CAST(sum(n_nationkey * n_nationkey) AS BIGINT) AS s FROM nation GROUP BY 1")
def udf_fold(spark: SparkSession, d: str) -> DataFrame:
    """Aggregate of one's own by a fold."""
    v = F.col("n_nationkey").cast("bigint")
    return table(spark, d, "nation").groupBy("n_regionkey").agg(udfs.custom_aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x * x).alias("s"))
