"""Relational queries over the retail and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
       sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge,
       avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def tpch_q01(spark: SparkSession, d: str) -> DataFrame:
    """Pricing summary: filter, eight aggregates, one small shuffle."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, d, "lineitem")
        .where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base_price"), F.sum(price).alias("sum_disc_price"),
            F.sum(price * (1 + F.col("l_tax"))).alias("sum_charge"), F.avg("l_quantity").alias("avg_qty"), F.avg("l_extendedprice").alias("avg_price"),
            F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
        )
    )
