"""One query or more per operator: joins, aggregation, windows, sorting, set operations, generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates, filters, joins
from .registry import query, sql, table

# --- projection, filter, predicates ------------------------------------------------------------------------------------
sql("op_project_filter", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 5) AS net, l_quantity > 25 AS large FROM {lineitem}
WHERE (l_returnflag = 'R' OR l_linestatus = 'O') AND NOT (l_discount < 0.02) AND l_tax IS NOT NULL AND l_shipdate >= DATE '2000-01-01'""")
sql("op_in_list_with_columns", "SELECT ss_item_sk, ss_quantity FROM {store_sales} WHERE ss_quantity IN (1, 2, 3, ss_store_sk)")
sql("op_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM {orders})")
sql("op_correlated_subquery", """
SELECT o_custkey, o_orderkey FROM {orders} o WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)""")
sql("op_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)")
sql("op_exists_or", """
SELECT c_custkey, c_name FROM {customer} WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 480000)""")
sql("op_not_in_sql", "SELECT s_store_sk FROM {store} WHERE s_store_sk NOT IN (SELECT ss_store_sk FROM {store_sales} WHERE ss_quantity > 95 AND ss_store_sk IS NOT NULL)")
sql("op_cte_twice", """
WITH t AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT a.n, count(*) AS pairs FROM t a JOIN t b ON a.o_custkey = b.o_custkey GROUP BY a.n""")
sql("op_one_row", "SELECT 1 AS one, 'x' AS x, CAST(NULL AS INT) AS nothing")
sql("op_values", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")

# --- joins -------------------------------------------------------------------------------------------------------------
for _how, _word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    sql(f"join_{_how}", f"""
SELECT ss_item_sk, ss_ticket_number, ss_store_sk, sr_item_sk, sr_store_sk, sr_return_quantity FROM {{store_sales}}
{_word} {{store_returns}} ON ss_item_sk = sr_item_sk AND ss_ticket_number = sr_ticket_number""")  # fmt: skip
sql("join_left_semi", "SELECT ss_ticket_number, ss_item_sk FROM {store_sales} LEFT SEMI JOIN {store_returns} ON ss_ticket_number = sr_ticket_number AND ss_item_sk = sr_item_sk",
    "SELECT ss_ticket_number, ss_item_sk FROM {store_sales} WHERE EXISTS (SELECT 1 FROM {store_returns} WHERE ss_ticket_number = sr_ticket_number AND ss_item_sk = sr_item_sk)")
sql("join_left_anti", "SELECT sr_ticket_number, sr_item_sk FROM {store_returns} LEFT ANTI JOIN {store_sales} ON ss_ticket_number = sr_ticket_number AND ss_item_sk = sr_item_sk",
    "SELECT sr_ticket_number, sr_item_sk FROM {store_returns} WHERE NOT EXISTS (SELECT 1 FROM {store_sales} WHERE ss_ticket_number = sr_ticket_number AND ss_item_sk = sr_item_sk)")
sql("join_residual", "SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate")
sql("join_null_safe", "SELECT count(*) AS n FROM {store_sales} JOIN {store} ON ss_store_sk <=> s_store_sk", "SELECT count(*) AS n FROM {store_sales} JOIN {store} ON ss_store_sk IS NOT DISTINCT FROM s_store_sk")
sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation} WHERE n_nationkey < 5")
sql("join_theta", "SELECT s_store_sk, count(*) AS n FROM {store} JOIN {nation} ON s_store_sk > n_nationkey GROUP BY s_store_sk")
sql("join_theta_left", "SELECT r_regionkey, n_nationkey FROM {region} LEFT JOIN {nation} ON n_nationkey > r_regionkey * 8")
sql("join_using", "SELECT count(*) AS n FROM (SELECT o_custkey AS k FROM {orders}) a JOIN (SELECT c_custkey AS k FROM {customer}) b USING (k)")
sql("join_lateral", """
SELECT s_store_sk, x.best FROM {store} s, LATERAL (SELECT max(ss_sales_price) AS best FROM {store_sales} WHERE ss_store_sk = s.s_store_sk) x""", """
SELECT s_store_sk, x.best FROM {store} s, LATERAL (SELECT max(ss_sales_price) AS best FROM {store_sales} WHERE ss_store_sk = s.s_store_sk) x""")

_HINTED = "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_mktsegment"

def _hinted(hint: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        c, o = table(spark, d, "customer").hint(hint), table(spark, d, "orders")
        return c.join(o, c.c_custkey == o.o_custkey).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    return run


for _hint in ("shuffle_hash", "merge"):
    query(_HINTED.replace("{", "").replace("}", ""), f"join_hint_{_hint}")(_hinted(_hint))


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey AND n_nationkey > r_regionkey GROUP BY 1")
def join_hint_shuffle_replicate_nl(spark: SparkSession, d: str) -> DataFrame:
    """A Cartesian product with a condition, of two small fixed tables."""
    n, r = table(spark, d, "nation"), table(spark, d, "region").hint("shuffle_replicate_nl")
    return n.join(r, (n.n_regionkey == r.r_regionkey) & (n.n_nationkey > r.r_regionkey)).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_checked_broadcast(spark: SparkSession, d: str) -> DataFrame:
    """The small side is broadcast after its size was checked."""
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.lookup(table(spark, d, "customer"), n, ["c_nationkey"]).select("c_custkey", "c_name", "n_name")


@query("SELECT ss_customer_sk AS k, count(*) AS n, CAST(sum(sr_return_quantity) AS BIGINT) AS q FROM store_sales JOIN store_returns ON ss_store_sk = sr_store_sk AND ss_customer_sk = sr_customer_sk GROUP BY 1")
def join_salted(spark: SparkSession, d: str) -> DataFrame:
    """Equi join on a skewed key whose hot values are spread."""
    s = table(spark, d, "store_sales").select("ss_store_sk", F.col("ss_customer_sk").alias("k"))
    r = table(spark, d, "store_returns").select("sr_store_sk", F.col("sr_customer_sk").alias("k"), "sr_return_quantity")
    j = joins.salted(s, r, "k").where("ss_store_sk = sr_store_sk")
    return j.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("sr_return_quantity").alias("q"))


@query("""
WITH r AS (SELECT d_date_sk AS lo, d_date_sk + 10 AS hi FROM date_dim WHERE d_dom = 1)
SELECT lo, count(*) AS n FROM store_sales JOIN r ON ss_sold_date_sk >= lo AND ss_sold_date_sk < hi GROUP BY lo""")
def join_range(spark: SparkSession, d: str) -> DataFrame:
    """Points in ranges by buckets."""
    r = table(spark, d, "date_dim").where("d_dom = 1").select(F.col("d_date_sk").alias("lo"), (F.col("d_date_sk") + 10).alias("hi"))
    return joins.range_join(table(spark, d, "store_sales").select("ss_sold_date_sk"), r, "ss_sold_date_sk", "lo", "hi", 10).groupBy("lo").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT user_id, ts, max(event_id) AS last_click, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT e.event_id, p.last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """The last click at or before every purchase of a user."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("last_click"))
    return joins.asof_join(left, right, ["user_id"], "ts", values=["last_click"]).select("event_id", "last_click")


@query("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 400000")
def join_bloom(spark: SparkSession, d: str) -> DataFrame:
    """The large side is filtered by the small side's keys before the shuffle."""
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return filters.bloom_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_not_in(spark: SparkSession, d: str) -> DataFrame:
    """Null-aware anti join."""
    return joins.not_in(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT s_store_sk FROM store WHERE s_store_sk NOT IN (SELECT ss_store_sk FROM store_sales)")
def join_not_in_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Null-aware anti join against keys with nulls: no row."""
    return joins.not_in(table(spark, d, "store"), table(spark, d, "store_sales"), "s_store_sk", "ss_store_sk").select("s_store_sk")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS big FROM customer")
def join_existence(spark: SparkSession, d: str) -> DataFrame:
    """Existence join."""
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.exists_flag(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "big")


# --- aggregation -------------------------------------------------------------------------------------------------------
sql("agg_basic", """
SELECT ss_store_sk, count(*) AS n, count(ss_quantity) AS nq, CAST(sum(ss_quantity) AS BIGINT) AS sq, round(avg(CAST(ss_quantity AS DOUBLE)), 6) AS aq, min(ss_sales_price) AS lo, max(ss_sales_price) AS hi
FROM {store_sales} GROUP BY ss_store_sk""")
sql("agg_statistics", """
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sds, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 4) AS vs, round(var_pop(l_quantity), 4) AS vp,
 round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(skewness(l_extendedprice), 3) AS sk
FROM {lineitem} GROUP BY l_returnflag""", """
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sds, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 4) AS vs, round(var_pop(l_quantity), 4) AS vp,
 round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs,
 round((avg(l_extendedprice ** 3) - 3 * avg(l_extendedprice) * avg(l_extendedprice ** 2) + 2 * avg(l_extendedprice) ** 3) / var_pop(l_extendedprice) ** 1.5, 3) AS sk
FROM {lineitem} GROUP BY l_returnflag""")
sql("agg_kurtosis", "SELECT l_linestatus, round(kurtosis(l_quantity), 4) AS k FROM {lineitem} GROUP BY l_linestatus", "SELECT l_linestatus, round(kurtosis_pop(l_quantity), 4) AS k FROM {lineitem} GROUP BY l_linestatus")
sql("agg_regression", """
SELECT l_returnflag, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icpt,
 round(regr_sxy(l_discount, l_quantity), 2) AS sxy, round(regr_sxx(l_discount, l_quantity), 2) AS sxx, round(regr_syy(l_discount, l_quantity), 4) AS syy,
 round(regr_avgx(l_discount, l_quantity), 6) AS ax, round(regr_avgy(l_discount, l_quantity), 6) AS ay, CAST(regr_count(l_discount, l_quantity) AS BIGINT) AS rc FROM {lineitem} GROUP BY l_returnflag""")
sql("agg_bits", "SELECT ss_store_sk, bit_and(ss_item_sk) AS a, bit_or(ss_item_sk) AS o, bit_xor(ss_item_sk) AS x FROM {store_sales} WHERE ss_store_sk IS NOT NULL GROUP BY ss_store_sk")
sql("agg_max_by_min_by", """
SELECT o_orderpriority, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest FROM {orders} GROUP BY o_orderpriority""")
sql("agg_bool_any", "SELECT l_returnflag, bool_and(l_quantity > 0) AS every_one, bool_or(l_discount > 0.09) AS some_one, count_if(l_tax > 0.05) AS many FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, bool_and(l_quantity > 0) AS every_one, bool_or(l_discount > 0.09) AS some_one, CAST(count_if(l_tax > 0.05) AS BIGINT) AS many FROM {lineitem} GROUP BY l_returnflag")
sql("agg_percentile_exact", "SELECT l_returnflag, round(percentile(l_extendedprice, 0.5), 4) AS p50, round(percentile(l_extendedprice, 0.9), 4) AS p90, round(median(l_quantity), 2) AS med FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(median(l_quantity), 2) AS med FROM {lineitem} GROUP BY l_returnflag")
# Sketches are held against exact values within the error that they promise.
sql("agg_percentile_approx", """
SELECT l_returnflag, count(*) AS n, percentile_approx(l_quantity, 0.5, 10000) BETWEEN percentile(l_quantity, 0.499) AND percentile(l_quantity, 0.501) AS p50,
 forall(zip_with(percentile_approx(l_quantity, array(0.25, 0.75), 10000), array(percentile(l_quantity, 0.25), percentile(l_quantity, 0.75)), (x, y) -> x - y), x -> abs(x) <= 1) AS quartiles FROM {lineitem} GROUP BY l_returnflag""",
    "SELECT l_returnflag, count(*) AS n, true AS p50, true AS quartiles FROM {lineitem} GROUP BY l_returnflag")
sql("agg_approx_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, abs(approx_count_distinct(l_partkey, 0.01) / count(DISTINCT l_partkey) - 1) <= 0.04 AS near FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM {lineitem} GROUP BY l_returnflag")
sql("agg_collect", "SELECT n_regionkey, sort_array(collect_list(n_name)) AS names, sort_array(collect_set(n_nationkey % 3)) AS kinds FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, list_sort(list(n_name)) AS names, list_sort(list(DISTINCT n_nationkey % 3)) AS kinds FROM {nation} GROUP BY n_regionkey")
sql("agg_first_last_ignore_nulls", "SELECT first_value(k) IGNORE NULLS AS f, last_value(k) IGNORE NULLS AS l, first(j) AS fj, last(j) AS lj FROM (VALUES (CAST(NULL AS INT), 7), (5, 7), (5, 7), (NULL, 7)) AS t(k, j)",
    "SELECT 5 AS f, 5 AS l, 7 AS fj, 7 AS lj")
sql("agg_distinct_two", "SELECT ss_store_sk, count(DISTINCT ss_item_sk) AS items, count(DISTINCT ss_customer_sk) AS customers, count(DISTINCT ss_quantity, ss_promo_sk) AS pairs FROM {store_sales} GROUP BY ss_store_sk",
    "SELECT ss_store_sk, count(DISTINCT ss_item_sk) AS items, count(DISTINCT ss_customer_sk) AS customers, count(DISTINCT CASE WHEN ss_quantity IS NOT NULL AND ss_promo_sk IS NOT NULL THEN (ss_quantity, ss_promo_sk) END) AS pairs FROM {store_sales} GROUP BY ss_store_sk")
sql("agg_filter", "SELECT ss_store_sk, count(*) FILTER (WHERE ss_quantity > 50) AS big, CAST(sum(ss_quantity) FILTER (WHERE ss_sales_price < 10) AS BIGINT) AS cheap FROM {store_sales} GROUP BY ss_store_sk")
sql("agg_global_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_shipdate) AS m FROM {lineitem} WHERE l_quantity < -1")
sql("agg_group_empty", "SELECT l_returnflag, count(*) AS n FROM {lineitem} WHERE l_quantity < -1 GROUP BY l_returnflag")
sql("agg_having", "SELECT ss_item_sk, count(*) AS n FROM {store_sales} GROUP BY ss_item_sk HAVING count(*) > 20 AND max(ss_sales_price) > 50")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS g FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT l_returnflag, l_linestatus, l_linenumber, CAST(sum(l_quantity) AS DOUBLE) AS q FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
sql("agg_group_by_ordinal", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1, 2 ORDER BY 1, 2")
sql("agg_nan_and_zero_keys", "SELECT CAST(k AS STRING) AS k, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 1 THEN double('NaN') WHEN l_linenumber = 2 THEN -0.0D WHEN l_linenumber = 3 THEN 0.0D ELSE 1.0D END AS k FROM {lineitem}) t GROUP BY k",
    "SELECT CASE WHEN k = 0 THEN '0.0' WHEN isnan(k) THEN 'NaN' ELSE '1.0' END AS k, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 1 THEN 'NaN'::DOUBLE WHEN l_linenumber IN (2, 3) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM {lineitem}) t GROUP BY k")
sql("agg_histogram_sketches", """
SELECT count(DISTINCT l_partkey) AS parts, abs(hll_sketch_estimate(hll_sketch_agg(l_partkey, 12)) / count(DISTINCT l_partkey) - 1) <= 0.06 AS hll, size(histogram_numeric(l_quantity, 5)) AS bins, mode(l_returnflag) AS m,
 round(aggregate(histogram_numeric(l_quantity, 5), 0.0D, (a, x) -> a + x.y)) AS counted FROM {lineitem}""",
    "SELECT count(DISTINCT l_partkey) AS parts, true AS hll, 5 AS bins, mode(l_returnflag) AS m, CAST(count(l_quantity) AS DOUBLE) AS counted FROM {lineitem}")


@query("SELECT ss_store_sk, count(CASE WHEN ss_quantity IS NOT NULL AND ss_customer_sk IS NOT NULL AND ss_promo_sk IS NOT NULL THEN 1 END) AS n FROM store_sales GROUP BY 1")
def agg_count_several(spark: SparkSession, d: str) -> DataFrame:
    """count(a, b, c)."""
    return table(spark, d, "store_sales").groupBy("ss_store_sk").agg(aggregates.count_all("ss_quantity", "ss_customer_sk", "ss_promo_sk").alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id, count(*) AS n FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""")
def agg_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """GROUPING SETS."""
    cols = ["l_returnflag", "l_linestatus"]
    x = aggregates.grouping_sets(table(spark, d, "lineitem"), cols, [cols, ["l_linestatus"], []], F.count(F.lit(1)).alias("n"))
    return x.select(*cols, F.col("grouping_id").cast("bigint").alias("grouping_id"), "n")


@query("SELECT ss_store_sk, CAST(sum(ss_quantity) AS BIGINT) AS total FROM store_sales GROUP BY 1")
def agg_two_level(spark: SparkSession, d: str) -> DataFrame:
    """Salted two-level sum."""
    return aggregates.two_level_sum(table(spark, d, "store_sales").select("ss_store_sk", "ss_quantity", "ss_ticket_number", "ss_item_sk"), ["ss_store_sk"], "ss_quantity")


@query("""
SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS DOUBLE) AS "F", CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS DOUBLE) AS "O" FROM lineitem GROUP BY 1""")
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Pivot over known values."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).sum("l_quantity")


@query("SELECT k, a.name AS measure, a.v AS v FROM (SELECT l_returnflag AS k, unnest([{'name': 'q', 'v': sum(l_quantity)}, {'name': 't', 'v': round(sum(l_tax), 4)}]) AS a FROM lineitem GROUP BY 1) t")
def agg_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Unpivot of aggregates."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.sum("l_quantity").alias("q"), F.round(F.sum("l_tax"), 4).alias("t"))
    return g.unpivot("k", ["q", "t"], "measure", "v")


# --- windows -----------------------------------------------------------------------------------------------------------
_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
sql("window_ranking", f"""
SELECT o_orderkey, CAST(row_number() {_W} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk,
 CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS pr,
 round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS cd, CAST(ntile(4) {_W} AS BIGINT) AS nt FROM {{orders}}""")
sql("window_offsets", f"""
SELECT o_orderkey, lag(o_totalprice) {_W} AS l1, lag(o_totalprice, 2, 0.0D) {_W} AS l2, lead(o_orderkey) {_W} AS n1, first_value(o_orderkey) {_W} AS f, last_value(o_orderkey) {_W} AS l,
 nth_value(o_orderkey, 2) {_W} AS second FROM {{orders}}""", f"""
SELECT o_orderkey, lag(o_totalprice) {_W} AS l1, lag(o_totalprice, 2, 0.0) {_W} AS l2, lead(o_orderkey) {_W} AS n1, first_value(o_orderkey) {_W} AS f, last_value(o_orderkey) {_W} AS l,
 nth_value(o_orderkey, 2) {_W} AS second FROM {{orders}}""")
sql("window_rows_frames", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
 round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 5) AS near,
 count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM {orders}""")
sql("window_range_frames", """
SELECT ss_ticket_number, ss_item_sk, ss_quantity, count(*) OVER (PARTITION BY ss_store_sk ORDER BY ss_sold_date_sk RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3,
 CAST(sum(ss_quantity) OVER (PARTITION BY ss_store_sk ORDER BY ss_sold_date_sk RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM {store_sales} WHERE ss_sold_date_sk IS NOT NULL""")
sql("window_range_interval", """
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS n FROM {orders}""")
sql("window_nulls_order", """
SELECT ss_ticket_number, ss_item_sk, CAST(rank() OVER (PARTITION BY ss_store_sk ORDER BY ss_promo_sk ASC NULLS LAST) AS BIGINT) AS a, CAST(rank() OVER (PARTITION BY ss_store_sk ORDER BY ss_promo_sk DESC NULLS FIRST) AS BIGINT) AS b FROM {store_sales}""")
sql("window_group_limit", """
SELECT * FROM (SELECT ss_store_sk, ss_ticket_number, ss_item_sk, ss_net_paid, CAST(row_number() OVER (PARTITION BY ss_store_sk ORDER BY ss_net_paid DESC NULLS LAST, ss_ticket_number, ss_item_sk, ss_quantity) AS BIGINT) AS rn FROM {store_sales}) t WHERE rn <= 3""")
sql("window_rank_limit", """
SELECT * FROM (SELECT l_partkey, l_orderkey, l_quantity, CAST(rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS BIGINT) AS rk FROM {lineitem}) t WHERE rk <= 2""")
sql("window_aggregates_whole", "SELECT n_nationkey, count(*) OVER () AS n, max(n_nationkey) OVER (PARTITION BY n_regionkey) AS top, min(n_name) OVER (PARTITION BY n_regionkey) AS first_name FROM {nation}")


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS k FROM orders) t WHERE k <= 1""")
def window_top_with_ties(spark: SparkSession, d: str) -> DataFrame:
    """First group of ties per customer."""
    return aggregates.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderpriority").asc()], 1, "dense_rank").select("o_custkey", "o_orderkey")


# --- sort, limit, sampling, partitions ---------------------------------------------------------------------------------
sql("sort_global", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey")
sql("sort_nulls", "SELECT ss_ticket_number, ss_item_sk, ss_promo_sk FROM {store_sales} ORDER BY ss_promo_sk DESC NULLS LAST, ss_ticket_number, ss_item_sk")
sql("sort_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
sql("limit_offset", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 10 OFFSET 7")
sql("limit_without_order", "SELECT count(*) AS n FROM (SELECT * FROM {lineitem} LIMIT 1000) t")


def _sampled(x: DataFrame, sample: DataFrame, share) -> DataFrame:  # noqa: ANN001
    """Per flag: whether the sample's share is the one wanted, within five standard deviations, and no row was drawn twice."""
    of = x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"))
    got = sample.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_row").alias("different"))
    p = share(F.col("l_returnflag"))
    near = F.abs(F.coalesce("n", F.lit(0)) - p * F.col("rows")) <= 5 * F.sqrt(F.col("rows") * p * (1 - p))
    return of.join(got, "l_returnflag", "left").select("l_returnflag", "rows", near.alias("near"), (F.coalesce("n", F.lit(0)) == F.coalesce("different", F.lit(0))).alias("once"))


_SAMPLED = "SELECT l_returnflag, count(*) AS rows, true AS near, true AS once FROM lineitem GROUP BY 1"


@query(_SAMPLED)
def sample_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Sampling without replacement, with a seed."""
    x = table(spark, d, "lineitem").withColumn("_row", F.monotonically_increasing_id())
    return _sampled(x, x.sample(False, 0.1, 7), lambda flag: F.lit(0.1))


@query(_SAMPLED)
def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    """Sampling by stratum; one that isn't named gives nothing."""
    x = table(spark, d, "lineitem").withColumn("_row", F.monotonically_increasing_id())
    return _sampled(x, x.sampleBy("l_returnflag", {"A": 0.5, "N": 0.1}, 7), lambda flag: F.when(flag == "A", 0.5).when(flag == "N", 0.1).otherwise(0.0))


def _by_partition(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), (F.max("p") < 16).alias("few"))


for _name, _f in {
    "partition_hash": lambda x: x.repartition(16, "o_custkey"),
    "partition_range": lambda x: x.repartitionByRange(16, "o_orderkey"),
    "partition_round_robin": lambda x: x.repartition(16),
    "partition_coalesce": lambda x: x.coalesce(2),
    "partition_single": lambda x: x.coalesce(1),
}.items():
    query("SELECT count(*) AS n, true AS few FROM orders", _name)(lambda spark, d, f=_f: _by_partition(f(table(spark, d, "orders"))))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders")
def sort_within_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Local sort after hash partitioning."""
    return table(spark, d, "orders").repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderdate").select("o_custkey", "o_orderkey", "o_orderdate")


# --- set operations ----------------------------------------------------------------------------------------------------
_A, _B = "SELECT ss_store_sk AS a, ss_quantity AS b FROM {store_sales}", "SELECT sr_store_sk AS a, sr_return_quantity AS b FROM {store_returns}"
for _op in ("UNION ALL", "UNION", "INTERSECT", "EXCEPT", "INTERSECT ALL", "EXCEPT ALL"):
    sql("set_" + _op.lower().replace(" ", "_"), f"SELECT a, b, count(*) AS n FROM ({_A} {_op} {_B}) t GROUP BY a, b")


@query("SELECT a, b, CAST(c AS BIGINT) AS c FROM (SELECT n_nationkey AS a, n_name AS b, NULL AS c FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region) t")
def set_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Union by name, columns missing on one side."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("a"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("a"), F.lit(1).cast("bigint").alias("c"), F.col("r_name").alias("b"))
    return n.unionByName(r, allowMissingColumns=True).select("a", "b", "c")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_order FROM orders")
def set_drop_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows without repeats by some columns, settled by an order."""
    w = W.partitionBy("o_custkey")
    return table(spark, d, "orders").select("o_custkey", F.min("o_orderkey").over(w).alias("first_order")).dropDuplicates(["o_custkey"])


# --- generators --------------------------------------------------------------------------------------------------------
# Both numbers out of sums, which are combined before the shuffle; a DISTINCT count would shuffle every pair of word and text.
sql("gen_explode", """
SELECT w, CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS docs FROM (SELECT w, 1 AS n, 0 AS d FROM {documents} LATERAL VIEW explode(split(text, ' ')) x AS w
 UNION ALL SELECT w, 0, 1 FROM {documents} LATERAL VIEW explode(array_distinct(split(text, ' '))) x AS w) t GROUP BY w""",
    "SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM {documents}) t GROUP BY w")
sql("gen_explode_outer", "SELECT k, v FROM (VALUES (1, array(1, 2)), (2, array()), (3, CAST(NULL AS ARRAY<INT>))) AS t(k, a) LATERAL VIEW OUTER explode(a) x AS v", "SELECT * FROM (VALUES (1, 1), (1, 2), (2, NULL), (3, NULL)) AS t(k, v)")
sql("gen_posexplode", "SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, x",
    "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM {embeddings}")
sql("gen_posexplode_outer", "SELECT k, p, v FROM (VALUES (1, array('a', 'b')), (2, CAST(NULL AS ARRAY<STRING>))) AS t(k, a) LATERAL VIEW OUTER posexplode(a) x AS p, v", "SELECT * FROM (VALUES (1, 0, 'a'), (1, 1, 'b'), (2, NULL, NULL)) AS t(k, p, v)")
sql("gen_explode_map", "SELECT n_nationkey, k, v FROM {nation} LATERAL VIEW explode(map('name', n_name, 'region', CAST(n_regionkey AS STRING))) m AS k, v",
    "SELECT n_nationkey, 'name' AS k, n_name AS v FROM {nation} UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM {nation}")
sql("gen_inline", "SELECT n_nationkey, a, b FROM {nation} LATERAL VIEW inline(array(struct(n_name AS a, 1 AS b), struct(lower(n_name) AS a, 2 AS b))) x", "SELECT n_nationkey, n_name AS a, 1 AS b FROM {nation} UNION ALL SELECT n_nationkey, lower(n_name), 2 FROM {nation}")
sql("gen_stack", "SELECT r_regionkey, k, v FROM {region} LATERAL VIEW stack(2, 'n', r_name, 'l', lower(r_name)) s AS k, v", "SELECT r_regionkey, 'n' AS k, r_name AS v FROM {region} UNION ALL SELECT r_regionkey, 'l', lower(r_name) FROM {region}")
sql("gen_json_tuple", "SELECT event_id, k FROM {events} LATERAL VIEW json_tuple(props, 'k') j AS k", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}")
sql("gen_sequence", "SELECT n_nationkey, s FROM {nation} LATERAL VIEW explode(sequence(0, n_nationkey % 4)) x AS s", "SELECT n_nationkey, CAST(s AS INT) AS s FROM (SELECT n_nationkey, unnest(range(0, n_nationkey % 4 + 1)) AS s FROM {nation}) t")
