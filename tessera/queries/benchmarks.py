"""Queries in the shape of the well-known decision-support and click-stream benchmarks, as far as the tables' columns go."""

from __future__ import annotations

from .registry import sql

# --- orders and line items ---------------------------------------------------------------------------------------------
sql("tpch_q03", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
sql("tpch_q04", """
SELECT o_orderpriority, count(*) AS order_count FROM {orders}
WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
  AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY)
GROUP BY o_orderpriority""")
sql("tpch_q05", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1999-01-01' GROUP BY n_name""")
sql("tpch_q06", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
sql("tpch_q07", """
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM {supplier} JOIN {lineitem} ON s_suppkey = l_suppkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
  JOIN {nation} n1 ON s_nationkey = n1.n_nationkey JOIN {nation} n2 ON c_nationkey = n2.n_nationkey
  WHERE (n1.n_name IN ('NATION_1', 'NATION_2', 'NATION_3') AND n2.n_name IN ('NATION_4', 'NATION_5', 'NATION_6'))
     OR (n1.n_name IN ('NATION_4', 'NATION_5', 'NATION_6') AND n2.n_name IN ('NATION_1', 'NATION_2', 'NATION_3'))) s
GROUP BY supp_nation, cust_nation, l_year""")
sql("tpch_q08", """
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM {part} JOIN {lineitem} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {orders} ON l_orderkey = o_orderkey
  JOIN {customer} ON o_custkey = c_custkey JOIN {nation} n1 ON c_nationkey = n1.n_nationkey JOIN {region} ON n1.n_regionkey = r_regionkey
  JOIN {nation} n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') v GROUP BY o_year""")
sql("tpch_q10", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
sql("tpch_q12", """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY l_linestatus""")
sql("tpch_q13", """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey) c
GROUP BY c_count""")
sql("tpch_q14", """
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1998-09-01' AND l_shipdate < DATE '1998-10-01'""")
sql("tpch_q15", """
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM {lineitem}
  WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {supplier} JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""")
sql("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE p_brand = 'Brand#2' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM {lineitem} l2 WHERE l2.l_partkey = p_partkey)""")
sql("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS qty FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
sql("tpch_q19", """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#2' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 25)
   OR (p_brand = 'Brand#17' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 40) OR (p_brand = 'Brand#5' AND l_quantity BETWEEN 20 AND 30)""")
sql("tpch_q21", """
SELECT s_name, count(*) AS numwait FROM {supplier} JOIN {lineitem} l1 ON s_suppkey = l1.l_suppkey JOIN {orders} ON o_orderkey = l1.l_orderkey JOIN {nation} ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND n_name IN ('NATION_3', 'NATION_7')
  AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name""")
sql("tpch_q22", """
SELECT segment, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
  SELECT substring(c_mktsegment, 1, 4) AS segment, c_acctbal FROM {customer}
  WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)) c
GROUP BY segment""")

# --- retail ------------------------------------------------------------------------------------------------------------
sql("retail_q03_brand_by_year", """
SELECT d_year, i_brand_id, round(CAST(sum(ss_ext_sales_price) AS DOUBLE), 2) AS sum_agg FROM {date_dim} JOIN {store_sales} ON d_date_sk = ss_sold_date_sk JOIN {item} ON ss_item_sk = i_item_sk
WHERE d_moy = 1 GROUP BY d_year, i_brand_id""")
sql("retail_q09_buckets", """
SELECT CASE WHEN (SELECT count(*) FROM {store_sales} WHERE ss_quantity BETWEEN 1 AND 20) > 3000 THEN 'many' ELSE 'few' END AS bucket1,
  (SELECT round(CAST(avg(ss_ext_discount_amt) AS DOUBLE), 4) FROM {store_sales} WHERE ss_quantity BETWEEN 21 AND 40) AS bucket2,
  (SELECT round(CAST(avg(ss_net_paid) AS DOUBLE), 4) FROM {store_sales} WHERE ss_quantity BETWEEN 41 AND 60) AS bucket3""")
sql("retail_q12_class_share", """
SELECT i_item_id, i_class, round(CAST(sum(ss_ext_sales_price) AS DOUBLE), 2) AS itemrevenue,
  round(CAST(sum(ss_ext_sales_price) AS DOUBLE) * 100 / nullif(CAST(sum(sum(ss_ext_sales_price)) OVER (PARTITION BY i_class) AS DOUBLE), 0), 4) AS revenueratio
FROM {store_sales} JOIN {item} ON ss_item_sk = i_item_sk JOIN {date_dim} ON ss_sold_date_sk = d_date_sk
WHERE d_date BETWEEN DATE '2001-01-05' AND DATE '2001-03-05' GROUP BY i_item_id, i_class""")
sql("retail_q17_stddev", """
SELECT s_state, count(ss_quantity) AS n, round(avg(CAST(ss_quantity AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST(ss_quantity AS DOUBLE)), 4) AS sd,
  round(stddev_samp(CAST(ss_quantity AS DOUBLE)) / avg(CAST(ss_quantity AS DOUBLE)), 4) AS cov
FROM {store_sales} JOIN {store} ON ss_store_sk = s_store_sk JOIN {store_returns} ON ss_ticket_number = sr_ticket_number AND ss_item_sk = sr_item_sk GROUP BY s_state""")
sql("retail_q22_rollup", """
SELECT i_category, i_brand, round(avg(CAST(ss_quantity AS DOUBLE)), 4) AS qoh, CAST(grouping(i_category) + grouping(i_brand) AS BIGINT) AS lochierarchy
FROM {store_sales} JOIN {item} ON ss_item_sk = i_item_sk GROUP BY ROLLUP (i_category, i_brand)""")
sql("retail_q28_side_by_side", """
SELECT * FROM (SELECT round(CAST(avg(ss_list_price) AS DOUBLE), 4) AS b1_lp, count(ss_list_price) AS b1_cnt, count(DISTINCT ss_list_price) AS b1_cntd FROM {store_sales} WHERE ss_quantity BETWEEN 0 AND 5 AND ss_list_price BETWEEN 8 AND 18) b1
CROSS JOIN (SELECT round(CAST(avg(ss_list_price) AS DOUBLE), 4) AS b2_lp, count(ss_list_price) AS b2_cnt, count(DISTINCT ss_list_price) AS b2_cntd FROM {store_sales} WHERE ss_quantity BETWEEN 6 AND 10 AND ss_list_price BETWEEN 90 AND 100) b2""")
sql("retail_q34_tickets", """
SELECT ss_ticket_number, ss_customer_sk, cnt FROM (
  SELECT ss_ticket_number, ss_customer_sk, count(*) AS cnt FROM {store_sales} JOIN {date_dim} ON ss_sold_date_sk = d_date_sk JOIN {store} ON ss_store_sk = s_store_sk
  WHERE d_dom BETWEEN 1 AND 3 GROUP BY ss_ticket_number, ss_customer_sk) t WHERE cnt BETWEEN 3 AND 20""")
sql("retail_q38_intersect", """
SELECT count(*) AS n FROM (
  SELECT DISTINCT ss_customer_sk AS c FROM {store_sales} JOIN {date_dim} ON ss_sold_date_sk = d_date_sk WHERE d_moy = 1
  INTERSECT SELECT DISTINCT ss_customer_sk FROM {store_sales} JOIN {date_dim} ON ss_sold_date_sk = d_date_sk WHERE d_moy = 2
  INTERSECT SELECT DISTINCT sr_customer_sk FROM {store_returns}) hot""")
sql("retail_q44_best_and_worst", """
SELECT a.rnk, a.item AS best, b.item AS worst FROM
 (SELECT ss_item_sk AS item, CAST(rank() OVER (ORDER BY avg(CAST(ss_net_profit AS DOUBLE)) ASC, ss_item_sk) AS BIGINT) AS rnk FROM {store_sales} WHERE ss_store_sk = 4 AND ss_item_sk IS NOT NULL AND ss_net_profit IS NOT NULL GROUP BY ss_item_sk) a
 JOIN (SELECT ss_item_sk AS item, CAST(rank() OVER (ORDER BY avg(CAST(ss_net_profit AS DOUBLE)) DESC, ss_item_sk) AS BIGINT) AS rnk FROM {store_sales} WHERE ss_store_sk = 4 AND ss_item_sk IS NOT NULL AND ss_net_profit IS NOT NULL GROUP BY ss_item_sk) b
 ON a.rnk = b.rnk WHERE a.rnk <= 10""")
sql("retail_q47_neighbours", """
WITH v AS (SELECT ss_store_sk, d_year, d_moy, CAST(sum(ss_sales_price) AS DOUBLE) AS sales FROM {store_sales} JOIN {date_dim} ON ss_sold_date_sk = d_date_sk WHERE ss_store_sk IS NOT NULL GROUP BY 1, 2, 3)
SELECT ss_store_sk, d_year, d_moy, round(sales, 2) AS sales, round(avg(sales) OVER (PARTITION BY ss_store_sk, d_year), 2) AS avg_sales,
  round(lag(sales) OVER (PARTITION BY ss_store_sk ORDER BY d_year, d_moy), 2) AS psum, round(lead(sales) OVER (PARTITION BY ss_store_sk ORDER BY d_year, d_moy), 2) AS nsum FROM v""")
sql("retail_q51_cumulative", """
WITH s AS (SELECT ss_store_sk AS k, ss_sold_date_sk AS d, CAST(sum(ss_sales_price) AS DOUBLE) AS x FROM {store_sales} WHERE ss_store_sk IS NOT NULL AND ss_sold_date_sk IS NOT NULL GROUP BY 1, 2),
r AS (SELECT sr_store_sk AS k, sr_returned_date_sk AS d, CAST(sum(sr_return_amt) AS DOUBLE) AS x FROM {store_returns} WHERE sr_store_sk IS NOT NULL AND sr_returned_date_sk IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(s.k, r.k) AS store, coalesce(s.d, r.d) AS day, round(sum(s.x) OVER (PARTITION BY coalesce(s.k, r.k) ORDER BY coalesce(s.d, r.d)), 2) AS sold,
  round(sum(r.x) OVER (PARTITION BY coalesce(s.k, r.k) ORDER BY coalesce(s.d, r.d)), 2) AS returned FROM s FULL OUTER JOIN r ON s.k = r.k AND s.d = r.d""")
sql("retail_q65_cheap_items", """
WITH sa AS (SELECT ss_store_sk, ss_item_sk, CAST(sum(ss_sales_price) AS DOUBLE) AS revenue FROM {store_sales} WHERE ss_store_sk IS NOT NULL AND ss_item_sk IS NOT NULL GROUP BY 1, 2),
sb AS (SELECT ss_store_sk, avg(revenue) AS ave FROM sa GROUP BY 1)
SELECT s_store_name, i_item_id, round(revenue, 2) AS revenue FROM sa JOIN sb ON sa.ss_store_sk = sb.ss_store_sk JOIN {store} ON s_store_sk = sa.ss_store_sk JOIN {item} ON i_item_sk = sa.ss_item_sk WHERE revenue <= 0.1 * ave""")
sql("retail_q67_rank_in_rollup", """
SELECT * FROM (SELECT i_category, i_class, s_store_id, sumsales, CAST(rank() OVER (PARTITION BY i_category ORDER BY sumsales DESC) AS BIGINT) AS rk FROM (
  SELECT i_category, i_class, s_store_id, round(CAST(sum(coalesce(ss_sales_price * ss_quantity, 0)) AS DOUBLE), 2) AS sumsales FROM {store_sales} JOIN {store} ON ss_store_sk = s_store_sk JOIN {item} ON ss_item_sk = i_item_sk
  GROUP BY ROLLUP (i_category, i_class, s_store_id)) dw1) dw2 WHERE rk <= 10""")
sql("retail_q72_left_join_residual", """
SELECT d_week_seq, count(*) AS total, CAST(sum(CASE WHEN sr_item_sk IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM {store_sales} JOIN {date_dim} ON ss_sold_date_sk = d_date_sk
LEFT JOIN {store_returns} ON sr_item_sk = ss_item_sk AND sr_ticket_number = ss_ticket_number AND sr_return_quantity <= ss_quantity GROUP BY d_week_seq""")
sql("retail_q87_except", """
SELECT count(*) AS n FROM (SELECT ss_customer_sk, ss_store_sk FROM {store_sales} WHERE ss_quantity > 50 EXCEPT SELECT sr_customer_sk, sr_store_sk FROM {store_returns}) t""")
sql("retail_q93_outer", """
SELECT ss_customer_sk, round(CAST(sum(CASE WHEN sr_return_quantity IS NOT NULL THEN (ss_quantity - sr_return_quantity) * ss_sales_price ELSE ss_quantity * ss_sales_price END) AS DOUBLE), 2) AS sumsales
FROM {store_sales} LEFT JOIN {store_returns} ON sr_item_sk = ss_item_sk AND sr_ticket_number = ss_ticket_number WHERE ss_customer_sk IS NOT NULL GROUP BY ss_customer_sk""")
sql("retail_q96_count", """
SELECT count(*) AS n FROM {store_sales} JOIN {store} ON ss_store_sk = s_store_sk WHERE s_number_employees > 200 AND ss_quantity BETWEEN 5 AND 30""")
sql("retail_q97_full_outer", """
WITH a AS (SELECT ss_customer_sk AS c, ss_item_sk AS i FROM {store_sales} GROUP BY 1, 2), b AS (SELECT sr_customer_sk AS c, sr_item_sk AS i FROM {store_returns} GROUP BY 1, 2)
SELECT CAST(sum(CASE WHEN a.c IS NOT NULL AND b.c IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS store_only, CAST(sum(CASE WHEN a.c IS NULL AND b.c IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS return_only,
  CAST(sum(CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both FROM a FULL OUTER JOIN b ON a.c = b.c AND a.i = b.i""")

# --- click stream ------------------------------------------------------------------------------------------------------
sql("clicks_distinct_users", "SELECT event_type, count(DISTINCT user_id) AS u, count(*) AS c, round(avg(value), 4) AS a FROM {events} GROUP BY event_type")
sql("clicks_top_users", "SELECT user_id, event_type, count(*) AS c FROM {events} GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10")
sql("clicks_top_offset", "SELECT user_id, count(*) AS c FROM {events} GROUP BY user_id HAVING count(*) > 5 ORDER BY c DESC, user_id LIMIT 10 OFFSET 20")
sql("clicks_case_of_value", """
SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band, count(*) AS c, min(ts) AS first_ts, max(ts) AS last_ts FROM {events} GROUP BY 1""")
sql("clicks_by_minute", "SELECT date_trunc('hour', ts) AS h, count(*) AS pageviews FROM {events} WHERE event_type = 'click' GROUP BY 1 ORDER BY h")
sql("clicks_like", "SELECT count(*) AS n, min(doc_id) AS first_doc FROM {documents} WHERE text LIKE '%valve%' AND lang IS NOT NULL")
sql("clicks_regexp_domain", r"""
SELECT k, round(avg(l), 4) AS l, count(*) AS c, min(u) AS u FROM (SELECT regexp_replace(u, '^([A-Z]+).*$', '$1') AS k, length(u) AS l, u FROM (SELECT publication_number AS u FROM {documents}) d) t
GROUP BY k HAVING count(*) > 1""", r"""
SELECT k, round(avg(l), 4) AS l, count(*) AS c, min(u) AS u FROM (SELECT regexp_replace(u, '^([A-Z]+).*$', '\1') AS k, length(u) AS l, u FROM (SELECT publication_number AS u FROM documents) d) t
GROUP BY k HAVING count(*) > 1""")
