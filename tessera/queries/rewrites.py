"""The rewrites of ``plans``, against the plain SQL that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import join_order, rewrites
from .registry import query, table


@query("""
SELECT (SELECT count(*) FROM store_sales WHERE ss_quantity BETWEEN 1 AND 20) AS c1, (SELECT round(CAST(avg(ss_list_price) AS DOUBLE), 4) FROM store_sales WHERE ss_quantity BETWEEN 21 AND 40) AS a2,
 (SELECT count(DISTINCT ss_item_sk) FROM store_sales WHERE ss_quantity BETWEEN 41 AND 60 AND ss_store_sk = 1) AS d3, (SELECT max(ss_net_paid) FROM store_sales WHERE ss_promo_sk < 10) AS m4""")
def rewrite_multi_agg(spark: SparkSession, d: str) -> DataFrame:
    """Scalar aggregates with different filters in one scan."""
    q = F.col("ss_quantity")
    return rewrites.multi_agg(
        table(spark, d, "store_sales"),
        {
            "c1": (q.between(1, 20), "count", F.lit(1)), "a2": (q.between(21, 40), "avg", F.col("ss_list_price").cast("double")),
            "d3": (q.between(41, 60) & (F.col("ss_store_sk") == 1), "count_distinct", F.col("ss_item_sk")), "m4": (F.col("ss_promo_sk") < 10, "max", F.col("ss_net_paid")),
        },
    ).withColumn("a2", F.round("a2", 4))


@query("""
SELECT i_category, i_class, i_brand, CAST(grouping(i_category, i_class, i_brand) AS BIGINT) AS grouping_id, count(ss_quantity) AS n, CAST(sum(ss_quantity) AS BIGINT) AS q,
 max(ss_sales_price) AS hi, round(avg(CAST(ss_quantity AS DOUBLE)), 6) AS mean FROM store_sales JOIN item ON ss_item_sk = i_item_sk GROUP BY ROLLUP (i_category, i_class, i_brand)""")
def rewrite_rollup_from_finest(spark: SparkSession, d: str) -> DataFrame:
    """ROLLUP out of the finest level."""
    x = table(spark, d, "store_sales").join(table(spark, d, "item"), F.col("ss_item_sk") == F.col("i_item_sk"))
    named = {"n": ("count", "ss_quantity"), "q": ("sum", "ss_quantity"), "hi": ("max", "ss_sales_price"), "mean": ("avg", "ss_quantity")}
    r = rewrites.rollup_from_finest(x, ["i_category", "i_class", "i_brand"], named)
    return r.withColumn("grouping_id", F.col("grouping_id").cast("bigint")).withColumn("mean", F.round("mean", 6))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rewrite_cube_from_finest(spark: SparkSession, d: str) -> DataFrame:
    """CUBE out of the finest level."""
    a, b = "l_returnflag", "l_linestatus"
    r = rewrites.rollup_from_finest(table(spark, d, "lineitem"), [a, b], {"q": ("sum", "l_quantity")}, [[a, b], [a], [b], []])
    return r.withColumn("grouping_id", F.col("grouping_id").cast("bigint"))


@query("SELECT ss_store_sk, count(DISTINCT ss_customer_sk) AS customers, CAST(sum(ss_quantity) AS BIGINT) AS q, count(*) AS n FROM store_sales GROUP BY 1")
def rewrite_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    """count(DISTINCT) beside other aggregates without Expand."""
    x = table(spark, d, "store_sales").withColumn("one", F.lit(1))
    return rewrites.count_distinct_two_level(x, ["ss_store_sk"], "ss_customer_sk", "customers", ("q", "sum", "ss_quantity"), ("n", "count", "one"))


@query("SELECT ss_ticket_number, ss_item_sk FROM store_sales WHERE (ss_store_sk, ss_item_sk, ss_customer_sk) IN (SELECT sr_store_sk, sr_item_sk, sr_customer_sk FROM store_returns)")
def rewrite_semi_join_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Semi join on three columns against distinct keys."""
    on = ["ss_store_sk", "ss_item_sk", "ss_customer_sk"]
    r = table(spark, d, "store_returns").select(*[F.col(c.replace("ss_", "sr_")).alias(c) for c in on])
    return rewrites.semi_join_distinct(table(spark, d, "store_sales"), r, on).select("ss_ticket_number", "ss_item_sk")


@query("SELECT DISTINCT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey")
def rewrite_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders of several suppliers, without the self join."""
    return rewrites.keys_with_several(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT l_shipdate, l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2 ORDER BY l_shipdate, l_returnflag LIMIT 50")
def rewrite_top_groups(spark: SparkSession, d: str) -> DataFrame:
    """LIMIT pushed below the aggregate by its sort keys."""
    x = table(spark, d, "lineitem")
    return rewrites.top_groups(x, ["l_shipdate", "l_returnflag"], [("l_shipdate", True)], 50, F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem WHERE extract(YEAR FROM l_shipdate) = 1998 OR (extract(YEAR FROM l_shipdate) = 1999 AND extract(MONTH FROM l_shipdate) = 12)")
def rewrite_date_ranges(spark: SparkSession, d: str) -> DataFrame:
    """year() and month() as ranges that reach the scan."""
    x = table(spark, d, "lineitem").where(rewrites.in_year("l_shipdate", 1998) | rewrites.in_month("l_shipdate", 1999, 12))
    return x.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.z') AS VARCHAR) AS z FROM events")
def rewrite_parse_json_once(spark: SparkSession, d: str) -> DataFrame:
    """Several paths of one JSON column by one parse."""
    return rewrites.parse_once(table(spark, d, "events").select("event_id", "props"), "props", "k bigint, z string", ["k", "z"]).drop("props")


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem, orders, customer, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE' GROUP BY n_name""")
def rewrite_join_order(spark: SparkSession, d: str) -> DataFrame:
    """Six relations joined in the greedy order."""
    t = lambda n: table(spark, d, n)
    rel = [join_order.Relation(n, t(n)) for n in ("lineitem", "orders", "customer", "supplier", "nation")]
    rel.append(join_order.Relation("region", t("region").where("r_name = 'EUROPE'"), filtered=True))
    c = lambda a, x, b, y: join_order.Condition(a, b, F.col(x) == F.col(y))
    on = [c("customer", "c_custkey", "orders", "o_custkey"), c("lineitem", "l_orderkey", "orders", "o_orderkey"), c("lineitem", "l_suppkey", "supplier", "s_suppkey"),
          c("supplier", "s_nationkey", "nation", "n_nationkey"), c("nation", "n_regionkey", "region", "r_regionkey")]
    x = join_order.join(rel, on)
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
