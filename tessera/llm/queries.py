"""The queries of the problems solved in this subpackage, and their SQL where DuckDB can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import small_files
from ..scratch import written
from . import distinct, encoding, leakage, mixing, packing, percentiles, top_n

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- 1: percentiles ----------------------------------------------------------------------------------------------------
PERCENTS = (25, 50, 90, 99)
MEASURES = ("ss_sales_price", "ss_quantity")


@query("""
WITH v AS (
  SELECT ss_store_sk, 'ss_sales_price' AS measure, CAST(ss_sales_price * 100 AS BIGINT) AS x FROM store_sales
  WHERE ss_store_sk IS NOT NULL AND ss_sales_price IS NOT NULL
  UNION ALL
  SELECT ss_store_sk, 'ss_quantity', ss_quantity * 100 FROM store_sales WHERE ss_store_sk IS NOT NULL AND ss_quantity IS NOT NULL),
r AS (SELECT ss_store_sk, measure, x, row_number() OVER (PARTITION BY ss_store_sk, measure ORDER BY x) AS k,
             count(*) OVER (PARTITION BY ss_store_sk, measure) AS n FROM v),
p AS (SELECT 25 AS pct UNION ALL SELECT 50 UNION ALL SELECT 90 UNION ALL SELECT 99)
SELECT ss_store_sk, measure, CAST(pct AS BIGINT) AS pct, CAST(min(x) AS BIGINT) AS value_x100
FROM r, p WHERE k * 100 >= pct * n GROUP BY ss_store_sk, measure, pct""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per store."""
    s = table(spark, d, "store_sales").where("ss_store_sk IS NOT NULL")
    p = percentiles.percentiles(s, ["ss_store_sk"], MEASURES, PERCENTS)
    return p.select("ss_store_sk", "measure", F.col("pct").cast("bigint").alias("pct"), (F.col("at_least") * 100).cast("bigint").alias("value_x100"))


@query("""
WITH v AS (
  SELECT ss_store_sk, 'ss_sales_price' AS measure, CAST(ss_sales_price AS DOUBLE) AS x FROM store_sales
  WHERE ss_store_sk IS NOT NULL AND ss_sales_price IS NOT NULL
  UNION ALL
  SELECT ss_store_sk, 'ss_quantity', CAST(ss_quantity AS DOUBLE) FROM store_sales WHERE ss_store_sk IS NOT NULL AND ss_quantity IS NOT NULL)
SELECT ss_store_sk, measure, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.95), 4) AS p95
FROM v GROUP BY ss_store_sk, measure""")
def p1_days_combined(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated percentiles per store out of the runs of separate days."""
    daily = percentiles.runs(table(spark, d, "store_sales").where("ss_store_sk IS NOT NULL"), ["ss_store_sk"], MEASURES, ["ss_sold_date_sk"])
    p = percentiles.percentiles_from_runs(percentiles.merge_runs(daily, ["ss_store_sk"]), ["ss_store_sk"], (50, 95))
    at = lambda x: F.round(F.max(F.when(F.col("pct") == x, F.col("interpolated"))), 4)
    return p.groupBy("ss_store_sk", "measure").agg(F.max("n").alias("n"), at(50).alias("median"), at(95).alias("p95"))


# --- 2: top N ----------------------------------------------------------------------------------------------------------
@query("""
WITH s AS (SELECT ss_store_sk, ss_item_sk, max(ss_sales_price) AS score FROM store_sales
           WHERE ss_store_sk IS NOT NULL AND ss_item_sk IS NOT NULL AND ss_sales_price IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY ss_store_sk ORDER BY score DESC, ss_item_sk) AS k FROM s)
SELECT ss_store_sk, ss_item_sk FROM r WHERE k <= 10""")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten items of highest price in each store."""
    return top_n.top_n(table(spark, d, "store_sales"), ["ss_store_sk"], "ss_item_sk", "ss_sales_price", 10).select("ss_store_sk", "ss_item_sk")


@query("""
WITH s AS (SELECT ss_customer_sk, ss_item_sk, max(ss_sales_price) AS score FROM store_sales
           WHERE ss_customer_sk IS NOT NULL AND ss_item_sk IS NOT NULL AND ss_sales_price IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY ss_customer_sk ORDER BY score DESC, ss_item_sk) AS k FROM s)
SELECT ss_customer_sk, ss_item_sk, CAST(score AS DOUBLE) AS score, CAST(k AS BIGINT) AS place FROM r WHERE k <= 3""")
def p2_many_groups(spark: SparkSession, d: str) -> DataFrame:
    """The three dearest items of every customer: very many groups, one of them (anonymous buyers) very large."""
    t = top_n.top_n(table(spark, d, "store_sales"), ["ss_customer_sk"], "ss_item_sk", "ss_sales_price", 3)
    return t.select("ss_customer_sk", "ss_item_sk", F.col("ss_sales_price").cast("double").alias("score"), F.col("place").cast("bigint").alias("place"))


# --- 3: distinct counts ------------------------------------------------------------------------------------------------
def _sales_runs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "store_sales").where("ss_sold_date_sk IS NOT NULL AND ss_store_sk IS NOT NULL")
    return distinct.distinct_runs(s, ["ss_sold_date_sk", "ss_store_sk"], "ss_customer_sk")


@query("""
WITH c AS (SELECT ss_sold_date_sk, ss_store_sk, count(DISTINCT ss_customer_sk) AS n FROM store_sales
           WHERE ss_sold_date_sk IS NOT NULL AND ss_store_sk IS NOT NULL AND ss_customer_sk IS NOT NULL GROUP BY 1, 2)
SELECT ss_sold_date_sk, arg_max(ss_store_sk, n) AS ss_store_sk FROM c GROUP BY 1""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """For each day the store with the most different customers."""
    c = distinct.counts(_sales_runs(spark, d), ["ss_sold_date_sk", "ss_store_sk"])
    return c.groupBy("ss_sold_date_sk").agg(F.max_by("ss_store_sk", F.struct("distinct_n", -F.col("ss_store_sk"))).alias("ss_store_sk"))


_BY = """SELECT '{0}' AS level, {1} AS day, {2} AS store, CAST(count(DISTINCT ss_customer_sk) AS BIGINT) AS distinct_n,
 count(DISTINCT ss_customer_sk) * (count(DISTINCT ss_customer_sk) - 1.0::DOUBLE) / 36893488147419103232.0::DOUBLE AS error_bound FROM store_sales
WHERE ss_sold_date_sk IS NOT NULL AND ss_store_sk IS NOT NULL AND ss_customer_sk IS NOT NULL GROUP BY 1, 2, 3"""


@query(" UNION ALL ".join((_BY.format("day", "ss_sold_date_sk", "CAST(NULL AS BIGINT)"), _BY.format("store", "CAST(NULL AS BIGINT)", "ss_store_sk"), _BY.format("day_store", "ss_sold_date_sk", "ss_store_sk"))))
def p3_days_stores_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Counts per day, per store and per pair; those of days and stores by union of the pairs' runs."""
    pairs = written(_sales_runs(spark, d), "distinct-runs")
    none, out = F.lit(None).cast("bigint"), None
    for level, by in (("day", ["ss_sold_date_sk"]), ("store", ["ss_store_sk"]), ("day_store", ["ss_sold_date_sk", "ss_store_sk"])):
        c = distinct.counts(pairs if len(by) == 2 else distinct.roll_up(pairs, by), by)
        c = c.select(F.lit(level).alias("level"), *[(F.col(k) if k in by else none).alias(a) for k, a in (("ss_sold_date_sk", "day"), ("ss_store_sk", "store"))], "distinct_n", "error_bound")
        out = c if out is None else out.unionByName(c)
    return out


# --- 5: containers -----------------------------------------------------------------------------------------------------
CAPACITY = 134_217_728
_FILES = r"""
WITH r AS (
  SELECT write_id, CASE WHEN size_in_bytes > 0 THEN size_in_bytes END AS b,
    rtrim(regexp_replace(regexp_replace(lower(trim(table_path)), '^file:/*', '/'), '/+', '/', 'g'), '/') AS t,
    trim(regexp_replace(regexp_replace(lower(replace(trim(partition_id), '%3D', '=')), '^\./', ''), '/+', '/', 'g'), '/') AS p,
    regexp_replace(trim(regexp_replace(trim(lower(part_name)), '^\./', ''), '/'), '^.*/', '') AS n
  FROM mergetree_delta_columnar_write),
f AS (SELECT t, p, n, min(write_id) AS write_id, max(b) AS bytes FROM r GROUP BY 1, 2, 3)
"""


def _packed(spark: SparkSession, d: str) -> DataFrame:
    f = small_files.files(table(spark, d, "mergetree_delta_columnar_write"))
    return packing.pack(f.where("bytes IS NOT NULL"), ["table", "partition"], "write_id", "bytes", CAPACITY)


@query(_FILES + "SELECT write_id, CAST(unnest(range(1, CAST(ceil(bytes / 134217728.0) AS BIGINT) + 1)) AS BIGINT) AS piece_no FROM f WHERE bytes > 134217728")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of files larger than a container."""
    return _packed(spark, d).where("pieces > 1").select("write_id", "piece_no")


@query(_FILES + "SELECT t AS table_path, p AS partition_id, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM f WHERE bytes > 0 GROUP BY 1, 2")
def p5_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Packed files and bytes per partition: every file is packed once and whole."""
    x = _packed(spark, d).groupBy("table", "partition", "write_id").agg(F.sum("piece_size").alias("b"))
    return x.groupBy(F.col("table").alias("table_path"), F.col("partition").alias("partition_id")).agg(F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"))


def _containers(spark: SparkSession, d: str) -> DataFrame:
    c = _packed(spark, d).groupBy("table", "partition", "container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_size").alias("b"))
    g = c.groupBy(F.col("table").alias("table_path"), F.col("partition").alias("partition_id")).agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("b").alias("bytes"), F.max("b").alias("fullest"))
    return g.withColumn("least", F.ceil(F.col("bytes") / CAPACITY))


@query(_FILES + """SELECT t AS table_path, p AS partition_id, CAST(sum(ceil(bytes / 134217728.0)) AS BIGINT) AS pieces, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(ceil(sum(bytes) / 134217728.0) AS BIGINT) AS least,
 true AS none_overfull, true AS under_twice_the_least FROM f WHERE bytes > 0 GROUP BY 1, 2""")
def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per partition: pieces and bytes packed and the least number of containers; none holds more than its capacity, and there
    are fewer than twice the least (of two containers, the later was opened for a piece that the earlier had no space for)."""
    g = _containers(spark, d)
    return g.select("table_path", "partition_id", "pieces", "bytes", "least", (F.col("fullest") <= CAPACITY).alias("none_overfull"), (F.col("containers") < 2 * F.col("least")).alias("under_twice_the_least"))


@query()
def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    """Per partition: containers used, the least number possible, and the share of space filled."""
    return _containers(spark, d).select("table_path", "partition_id", "containers", "least", (F.col("bytes") / (F.col("containers") * F.lit(CAPACITY))).alias("filled"))


# --- 6: leaked test items ----------------------------------------------------------------------------------------------
@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of a test item."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query()
def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked: documents, how much of the passage at most, and how often with the answer."""
    x = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return x.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.max("covered"), 3).alias("most_covered"), F.count_if("answer_found").alias("with_answer"))


# --- 7: mixtures -------------------------------------------------------------------------------------------------------
@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Passes over each source."""
    targets = table(spark, d, "mix_targets")
    counted = mixing.count_documents(table(spark, d, "documents"), targets)
    return mixing.plan(counted, targets).select("source", "n_passes", "falls_short")


@query()
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the selected documents actually reach."""
    targets = table(spark, d, "mix_targets")
    counted = mixing.count_documents(table(spark, d, "documents"), targets)
    planned = mixing.plan(counted, targets)
    mix = mixing.select(counted, planned)
    got = mix.groupBy("key").agg(F.sum(F.col("tokens") * F.col("passes")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("passes").alias("most_passes"))
    got = planned.join(got, "key", "left").fillna(0, ["tokens", "documents", "most_passes"])
    return got.select("source", "target_weight", "goal", "tokens", (F.col("tokens") / F.sum("tokens").over(W.partitionBy())).alias("share"), "documents", "most_passes", "falls_short", (F.col("goal") - F.col("tokens")).alias("gap"))


# --- 8: wrong encodings ------------------------------------------------------------------------------------------------
@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with wrongly decoded passages."""
    return encoding.repaired(table(spark, d, "documents").select("doc_id", "text")).select("doc_id")


@query()
def p8_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Those documents with the text as far as it can be restored."""
    return encoding.repaired(table(spark, d, "documents").select("doc_id", "text"))
