"""Queries over files: what to rewrite, and rewriting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import small_files
from ..scratch import new_path
from .registry import query, table

_FILES = r"""
WITH r AS (
  SELECT write_id, record_count, CASE WHEN size_in_bytes > 0 THEN size_in_bytes END AS b,
    rtrim(regexp_replace(regexp_replace(lower(trim(table_path)), '^file:/*', '/'), '/+', '/', 'g'), '/') AS t,
    trim(regexp_replace(regexp_replace(lower(replace(trim(partition_id), '%3D', '=')), '^\./', ''), '/+', '/', 'g'), '/') AS p,
    regexp_replace(trim(regexp_replace(trim(lower(part_name)), '^\./', ''), '/'), '^.*/', '') AS n
  FROM mergetree_delta_columnar_write),
f AS (SELECT t, p, n, min(write_id) AS write_id, max(record_count) AS records, max(b) AS bytes FROM r GROUP BY 1, 2, 3)
"""


@query(_FILES + """, s AS (SELECT *, count(*) OVER (PARTITION BY t, p) AS c FROM f WHERE records > 0 AND bytes < 16777216)
SELECT write_id FROM s WHERE c >= 2""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Files to be rewritten together: the rows of the compaction plan."""
    return small_files.plan(small_files.files(table(spark, d, "mergetree_delta_columnar_write"))).select("write_id")


@query(_FILES + """, s AS (SELECT t, p, bytes, records, count(*) OVER (PARTITION BY t, p) AS c FROM f WHERE records > 0 AND bytes < 16777216)
SELECT t AS table_path, p AS partition_id, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(records) AS BIGINT) AS records
FROM s WHERE c >= 2 GROUP BY 1, 2""")
def p4_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The plan's files, bytes and records per partition: nothing is lost or planned twice."""
    p = small_files.plan(small_files.files(table(spark, d, "mergetree_delta_columnar_write")))
    return p.groupBy(F.col("table").alias("table_path"), F.col("partition").alias("partition_id")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))


@query("""
SELECT sr_returned_date_sk, count(*) AS n, CAST(sum(sr_ticket_number) AS BIGINT) AS tickets, CAST(sum(sr_return_amt) AS DOUBLE) AS amount
FROM store_returns WHERE sr_returned_date_sk IS NOT NULL GROUP BY 1""")
def p4_returns_compacted(spark: SparkSession, d: str) -> DataFrame:
    """store_returns, written as many small files per day, joined block by block and read again."""
    small, out = new_path(spark, "small-files"), new_path(spark, "compacted")
    r = table(spark, d, "store_returns")
    r.write.partitionBy("sr_returned_date_sk").parquet(small)
    made = small_files.compact(spark, small, out).agg(F.count("path")).first()[0]
    back = spark.read.schema(r.schema).parquet(out) if made else spark.createDataFrame([], r.schema)
    return back.where("sr_returned_date_sk IS NOT NULL").groupBy(F.col("sr_returned_date_sk").cast("bigint").alias("sr_returned_date_sk")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sr_ticket_number").alias("tickets"), F.sum("sr_return_amt").cast("double").alias("amount")
    )
