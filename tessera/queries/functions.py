"""Scalar functions by kind. Where DuckDB has no equivalent, the query has no SQL and the tests hold known values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from .registry import query, sql, table

# --- arithmetic and logic ----------------------------------------------------------------------------------------------
sql("fn_arithmetic", """
SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, round(l_quantity * l_tax, 6) AS m, round(l_extendedprice / l_quantity, 6) AS d, l_orderkey % 7 AS r, pmod(-l_orderkey, 7) AS pm,
 -l_linenumber AS neg, +l_linenumber AS pos, abs(-l_quantity) AS ab, greatest(l_discount, l_tax, 0.03D) AS g, least(l_discount, l_tax) AS le, l_orderkey div 3 AS dv FROM {lineitem}""", """
SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, round(l_quantity * l_tax, 6) AS m, round(l_extendedprice / l_quantity, 6) AS d, l_orderkey % 7 AS r, ((-l_orderkey % 7) + 7) % 7 AS pm,
 -l_linenumber AS neg, +l_linenumber AS pos, abs(-l_quantity) AS ab, greatest(l_discount, l_tax, 0.03::DOUBLE) AS g, least(l_discount, l_tax) AS le, l_orderkey // 3 AS dv FROM {lineitem}""")
sql("fn_comparison", """
SELECT ss_ticket_number, ss_item_sk, ss_quantity = 5 AS eq, ss_quantity <=> ss_promo_sk AS nse, ss_quantity < 5 AS lt, ss_quantity <= 5 AS lte, ss_quantity > 5 AS gt, ss_quantity >= 5 AS gte, ss_quantity <> 5 AS ne,
 ss_quantity IS NULL AS isn, ss_quantity IS NOT NULL AS isnn, NOT (ss_quantity > 5) AS nt, ss_quantity > 5 AND ss_promo_sk > 5 AS an, ss_quantity > 5 OR ss_promo_sk > 5 AS o, ss_quantity IN (1, 2, 3) AS i,
 ss_quantity BETWEEN 3 AND 9 AS bt FROM {store_sales}""", """
SELECT ss_ticket_number, ss_item_sk, ss_quantity = 5 AS eq, ss_quantity IS NOT DISTINCT FROM ss_promo_sk AS nse, ss_quantity < 5 AS lt, ss_quantity <= 5 AS lte, ss_quantity > 5 AS gt, ss_quantity >= 5 AS gte, ss_quantity <> 5 AS ne,
 ss_quantity IS NULL AS isn, ss_quantity IS NOT NULL AS isnn, NOT (ss_quantity > 5) AS nt, ss_quantity > 5 AND ss_promo_sk > 5 AS an, ss_quantity > 5 OR ss_promo_sk > 5 AS o, ss_quantity IN (1, 2, 3) AS i,
 ss_quantity BETWEEN 3 AND 9 AS bt FROM {store_sales}""")
sql("fn_conditional", """
SELECT ss_ticket_number, ss_item_sk, coalesce(ss_quantity, ss_promo_sk, -1) AS co, CASE WHEN ss_quantity > 50 THEN 'big' WHEN ss_quantity > 10 THEN 'mid' ELSE 'small' END AS cw, if(ss_quantity > 10, 1, 0) AS i,
 nullif(ss_quantity, 5) AS nu, ifnull(ss_quantity, 0) AS ifn, nvl(ss_promo_sk, 0) AS nv, nvl2(ss_promo_sk, 1, 0) AS nv2 FROM {store_sales}""", """
SELECT ss_ticket_number, ss_item_sk, coalesce(ss_quantity, ss_promo_sk, -1) AS co, CASE WHEN ss_quantity > 50 THEN 'big' WHEN ss_quantity > 10 THEN 'mid' ELSE 'small' END AS cw, CASE WHEN ss_quantity > 10 THEN 1 ELSE 0 END AS i,
 nullif(ss_quantity, 5) AS nu, coalesce(ss_quantity, 0) AS ifn, coalesce(ss_promo_sk, 0) AS nv, CASE WHEN ss_promo_sk IS NOT NULL THEN 1 ELSE 0 END AS nv2 FROM {store_sales}""")
sql("fn_try_arithmetic", """
SELECT ss_ticket_number, ss_item_sk, try_divide(ss_quantity, ss_promo_sk - 5) AS d, try_add(ss_quantity, ss_promo_sk) AS a, try_subtract(ss_quantity, 9223372036854775807) AS s, try_multiply(ss_quantity, 2) AS m FROM {store_sales}""", """
SELECT ss_ticket_number, ss_item_sk, ss_quantity / nullif(ss_promo_sk - 5, 0) AS d, ss_quantity + ss_promo_sk AS a,
 CASE WHEN ss_quantity >= -1 THEN ss_quantity - 9223372036854775807 END AS s, ss_quantity * 2 AS m FROM {store_sales}""")
sql("fn_nan", "SELECT l_linenumber, isnan(x) AS n, nanvl(x, 9.0D) AS v FROM (SELECT DISTINCT l_linenumber, CASE WHEN l_linenumber < 3 THEN double('NaN') ELSE CAST(l_linenumber AS DOUBLE) END AS x FROM {lineitem}) t",
    "SELECT l_linenumber, isnan(x) AS n, CASE WHEN isnan(x) THEN 9.0 ELSE x END AS v FROM (SELECT DISTINCT l_linenumber, CASE WHEN l_linenumber < 3 THEN 'NaN'::DOUBLE ELSE CAST(l_linenumber AS DOUBLE) END AS x FROM {lineitem}) t")
sql("fn_casts", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS i, CAST(l_orderkey AS STRING) AS s, CAST('12' AS BIGINT) + l_orderkey AS b, CAST(l_extendedprice AS DECIMAL(12, 2)) AS d, CAST(l_shipdate AS DATE) AS dt,
 CAST(l_linenumber AS DOUBLE) AS f, CAST(l_linenumber > 2 AS INT) AS bi, CAST('true' AS BOOLEAN) AS t FROM {lineitem}""")
sql("fn_decimal", """
SELECT ss_ticket_number, ss_item_sk, ss_sales_price + ss_list_price AS a, ss_sales_price - ss_list_price AS s, CAST(ss_sales_price * ss_quantity AS DECIMAL(20, 2)) AS m, round(CAST(ss_sales_price AS DOUBLE) / 3, 6) AS d, ss_sales_price > ss_list_price AS gt FROM {store_sales}""")

# --- strings -----------------------------------------------------------------------------------------------------------
_S = "FROM {part}"
sql("fn_string_basic", f"""
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS lo, length(p_name) AS len, reverse(p_name) AS rev, trim(concat('  ', p_name, ' ')) AS tr, ltrim('  x') AS lt, rtrim('x  ') AS rt, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp,
 concat(p_name, '/', p_brand) AS c, concat_ws('-', p_name, p_brand, p_type) AS cw, replace(p_name, 'e', 'E') AS re, repeat(p_brand, 2) AS rr, substring(p_name, 2, 3) AS ss, left(p_name, 3) AS l3, right(p_name, 3) AS r3, ascii(p_name) AS asc, chr(65 + p_size % 26) AS ch {_S}""", f"""
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS lo, CAST(length(p_name) AS INT) AS len, reverse(p_name) AS rev, trim(concat('  ', p_name, ' ')) AS tr, ltrim('  x') AS lt, rtrim('x  ') AS rt, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp,
 concat(p_name, '/', p_brand) AS c, concat_ws('-', p_name, p_brand, p_type) AS cw, replace(p_name, 'e', 'E') AS re, repeat(p_brand, 2) AS rr, substring(p_name, 2, 3) AS ss, left(p_name, 3) AS l3, right(p_name, 3) AS r3, ascii(p_name) AS asc, chr(65 + p_size % 26) AS ch {_S}""")
sql("fn_string_search", f"""
SELECT p_partkey, instr(p_name, 'e') AS i, locate('e', p_name, 3) AS loc, position('e' IN p_name) AS pos, contains(p_name, 'ring') AS c, startswith(p_name, 'small') AS sw, endswith(p_name, 't') AS ew, p_name LIKE 's%g' AS li, p_name ILIKE 'S%' AS ili,
 p_name RLIKE '^[a-m]' AS rl, find_in_set(p_type, 'A,ECONOMY,PROMO') AS f {_S}""", f"""
SELECT p_partkey, CAST(instr(p_name, 'e') AS INT) AS i, CAST(CASE WHEN instr(substring(p_name, 3), 'e') = 0 THEN 0 ELSE instr(substring(p_name, 3), 'e') + 2 END AS INT) AS loc, CAST(position('e' IN p_name) AS INT) AS pos, contains(p_name, 'ring') AS c, starts_with(p_name, 'small') AS sw,
 ends_with(p_name, 't') AS ew, p_name LIKE 's%g' AS li, p_name ILIKE 'S%' AS ili, regexp_matches(p_name, '^[a-m]') AS rl, CAST(coalesce(list_position(['A', 'ECONOMY', 'PROMO'], p_type), 0) AS INT) AS f {_S}""")
sql("fn_string_regex", r"""
SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', 'N') AS rr, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS re, regexp_extract_all(p_name, '([aeiou])', 1) AS ra, split(p_name, ' ') AS sp, regexp_count(p_name, '[aeiou]') AS rc,
 regexp_substr(p_brand, '[0-9]+') AS rs, split_part(p_name, ' ', 1) AS spp, substring_index(p_name, ' ', 1) AS si FROM {part}""", r"""
SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS rr, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS re, regexp_extract_all(p_name, '([aeiou])', 1) AS ra, string_split(p_name, ' ') AS sp,
 CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INT) AS rc, regexp_extract(p_brand, '[0-9]+') AS rs, split_part(p_name, ' ', 1) AS spp, split_part(p_name, ' ', 1) AS si FROM {part}""")
sql("fn_string_edit", """
SELECT p_partkey, translate(p_name, 'aei', '123') AS t, initcap(p_name) AS ic, overlay(p_brand PLACING 'XX' FROM 2 FOR 3) AS ov, levenshtein(p_name, p_type) AS lv, space(3) AS sp, elt(2, p_name, p_brand) AS el, base64(CAST(p_name AS BINARY)) AS b64,
 CAST(unbase64(base64(CAST(p_name AS BINARY))) AS STRING) AS un, bit_length(p_name) AS bl, octet_length(p_name) AS ol, format_string('%s-%d', p_brand, p_size) AS fs FROM {part}""", """
SELECT p_partkey, translate(p_name, 'aei', '123') AS t, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS ic, substring(p_brand, 1, 1) || 'XX' || substring(p_brand, 5) AS ov,
 CAST(levenshtein(p_name, p_type) AS INT) AS lv, '   ' AS sp, p_brand AS el, to_base64(encode(p_name)) AS b64, p_name AS un, CAST(bit_length(p_name) AS INT) AS bl, CAST(strlen(p_name) AS INT) AS ol, p_brand || '-' || p_size AS fs FROM {part}""")
sql("fn_string_no_equivalent", """
SELECT p_partkey, soundex('Robert') AS s1, soundex('Rupert') AS s2, soundex('Honeyman') AS s3, soundex(p_name) = soundex(upper(p_name)) AS sx, conv(CAST(p_size AS STRING), 10, 16) AS cv, decode(encode(p_name, 'UTF-16'), 'UTF-16') AS de,
 parse_url(concat('http://h/p?k=', p_size), 'QUERY', 'k') AS pu, url_encode(p_name) AS ue, url_decode(url_encode(p_name)) AS ud, mask(p_brand) AS mk, format_number(p_retailprice, 1) AS fn, length(uuid()) AS ul, sentences(p_name) AS se,
 to_char(p_size, '999') AS tc, CAST(to_number(CAST(p_size AS STRING), '999') AS INT) AS tn, luhn_check('79927398713') AS lc, luhn_check('79927398714') AS ln, btrim('xax', 'x') AS bt, char_length(p_name) AS cl, printf('%05d', p_size) AS pf,
 is_valid_utf8(p_name) AS vu, length(randstr(4, 1)) AS rs, quote(p_name) AS qu FROM {part}""", """
SELECT p_partkey, 'R163' AS s1, 'R163' AS s2, 'H555' AS s3, true AS sx, printf('%X', p_size) AS cv, p_name AS de, CAST(p_size AS VARCHAR) AS pu, replace(url_encode(p_name), '%20', '+') AS ue, p_name AS ud,
 regexp_replace(regexp_replace(regexp_replace(p_brand, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS mk, format('{:,.1f}', p_retailprice) AS fn, 36 AS ul, [string_split(p_name, ' ')] AS se, lpad(CAST(p_size AS VARCHAR), 3, ' ') AS tc,
 CAST(p_size AS INT) AS tn, true AS lc, false AS ln, 'a' AS bt, CAST(length(p_name) AS INT) AS cl, lpad(CAST(p_size AS VARCHAR), 5, '0') AS pf, true AS vu, 4 AS rs, '''' || p_name || '''' AS qu FROM part""")
sql("fn_string_documents", "SELECT doc_id, length(text) AS n, md5(upper(text)) AS up, md5(text) AS m, size(split(text, '\\n')) AS lines FROM {documents}",
    "SELECT doc_id, CAST(length(text) AS INT) AS n, md5(upper(replace(replace(replace(text, 'ß', 'SS'), 'ﬁ', 'FI'), 'ﬂ', 'FL'))) AS up, md5(text) AS m, CAST(len(string_split(text, chr(10))) AS INT) AS lines FROM {documents}")

# --- mathematics -------------------------------------------------------------------------------------------------------
_MATH = ", ".join(f"round({e}, 8) AS {n}" for n, e in {
    "sq": "sqrt(l_quantity)", "cb": "cbrt(l_quantity)", "ex": "exp(l_discount)", "l_n": "ln(l_quantity)", "l10": "log10(l_quantity)", "l_2": "log2(l_quantity)", "pw": "power(l_discount, 3)", "sn": "sin(l_tax)", "cs": "cos(l_tax)",
    "tn": "tan(l_tax)", "ct": "cot(l_quantity)", "a_s": "asin(l_tax)", "ac": "acos(l_tax)", "at": "atan(l_quantity)", "at2": "atan2(l_quantity, l_tax)", "sh": "sinh(l_discount)", "chh": "cosh(l_discount)", "th": "tanh(l_discount)",
    "ash": "asinh(l_quantity)", "ach": "acosh(l_quantity)", "ath": "atanh(l_discount)", "rd": "radians(l_quantity)", "dg": "degrees(l_tax)", "p": "pi()"}.items())
sql("fn_math_real", f"SELECT l_orderkey, l_linenumber, {_MATH}, CAST(ceil(l_extendedprice) AS BIGINT) AS ce, CAST(floor(l_extendedprice) AS BIGINT) AS fl, round(l_extendedprice) AS ro, CAST(sign(l_discount - 0.05) AS DOUBLE) AS sg FROM {{lineitem}}")
sql("fn_math_more", """
SELECT l_orderkey, l_linenumber, round(expm1(l_tax), 8) AS em, round(log1p(l_tax), 8) AS lp, round(hypot(l_quantity, l_tax), 6) AS hy, rint(l_quantity) AS ri, round(e(), 8) AS ee, bround(l_linenumber / 2.0D, 0) AS br, round(log(2.0D, l_quantity), 8) AS lb,
 factorial(l_linenumber) AS fa, round(sec(l_tax), 8) AS sc, round(csc(l_quantity), 8) AS cc, width_bucket(l_quantity, 0.0D, 50.0D, 10) AS wb, CAST(ceil(CAST(l_extendedprice AS DECIMAL(12, 2)), 1) AS DOUBLE) AS c1, CAST(floor(CAST(-l_extendedprice AS DECIMAL(12, 2)), 1) AS DOUBLE) AS f1 FROM {lineitem}""", """
SELECT l_orderkey, l_linenumber, round(exp(l_tax) - 1, 8) AS em, round(ln(1 + l_tax), 8) AS lp, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS hy, round_even(l_quantity, 0) AS ri, round(exp(1), 8) AS ee, round_even(l_linenumber / 2.0, 0)::DOUBLE AS br, round(log2(l_quantity), 8) AS lb,
 CAST(factorial(l_linenumber) AS BIGINT) AS fa, round(1 / cos(l_tax), 8) AS sc, round(1 / sin(l_quantity), 8) AS cc, CAST(least(floor(l_quantity / 5) + 1, 11) AS BIGINT) AS wb,
 CAST(ceil(CAST(l_extendedprice AS DECIMAL(12, 2)) * 10) AS DOUBLE) / 10 AS c1, CAST(floor(CAST(-l_extendedprice AS DECIMAL(12, 2)) * 10) AS DOUBLE) / 10 AS f1 FROM {lineitem}""")
sql("fn_math_bits", """
SELECT l_orderkey, l_linenumber, l_orderkey & 12 AS a, l_orderkey | 12 AS o, l_orderkey ^ 12 AS x, ~l_orderkey AS n, shiftleft(l_linenumber, 3) AS sl, shiftright(l_orderkey, 2) AS sr, shiftrightunsigned(l_orderkey, 2) AS su, bit_count(l_orderkey) AS bc, getbit(l_orderkey, 1) AS gb,
 bin(l_linenumber) AS b, hex(l_orderkey) AS h, CAST(unhex(hex('ab')) AS STRING) AS uh FROM {lineitem}""", """
SELECT l_orderkey, l_linenumber, l_orderkey & 12 AS a, l_orderkey | 12 AS o, xor(l_orderkey, 12) AS x, ~l_orderkey AS n, l_linenumber << 3 AS sl, l_orderkey >> 2 AS sr, l_orderkey >> 2 AS su, CAST(bit_count(l_orderkey) AS INT) AS bc, CAST((l_orderkey >> 1) & 1 AS TINYINT) AS gb,
 bin(l_linenumber) AS b, hex(l_orderkey) AS h, 'ab' AS uh FROM {lineitem}""")
sql("fn_math_random", "SELECT count(*) AS n, min(r) >= 0 AND max(r) < 1 AS inside, count(g) AS g FROM (SELECT rand(3) AS r, randn(3) AS g FROM {orders}) t", "SELECT count(*) AS n, true AS inside, count(*) AS g FROM {orders}")

# --- dates and times ---------------------------------------------------------------------------------------------------
sql("fn_date_parts", """
SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, weekofyear(o_orderdate) AS w, dayofmonth(o_orderdate) AS d, dayofyear(o_orderdate) AS dy, dayofweek(o_orderdate) AS dw, weekday(o_orderdate) AS wd,
 CAST(extract(YEAROFWEEK FROM o_orderdate) AS INT) AS yw, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s FROM {orders}""", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(day(o_orderdate) AS INT) AS d, CAST(dayofyear(o_orderdate) AS INT) AS dy,
 CAST(dayofweek(o_orderdate) + 1 AS INT) AS dw, CAST(isodow(o_orderdate) - 1 AS INT) AS wd, CAST(isoyear(o_orderdate) AS INT) AS yw, CAST(hour(o_orderdate) AS INT) AS h, CAST(minute(o_orderdate) AS INT) AS mi, CAST(second(o_orderdate) AS INT) AS s FROM {orders}""")
sql("fn_date_arithmetic", """
SELECT d_date_sk, date_add(d_date, 10) AS a, date_sub(d_date, 10) AS s, datediff(DATE '2003-12-31', d_date) AS df, add_months(d_date, 1) AS am, last_day(d_date) AS ld, next_day(d_date, 'MON') AS nd, trunc(d_date, 'MM') AS tm, trunc(d_date, 'YEAR') AS ty, unix_date(d_date) AS ud,
 date_from_unix_date(unix_date(d_date)) AS fu, make_date(year(d_date), 1, 1) AS md, date_format(d_date, 'yyyy/MM/dd') AS f, to_date('2001-02-03') AS td, d_date + INTERVAL '1' MONTH AS im, round(months_between(d_date, DATE '2000-01-01'), 4) AS mb FROM {date_dim}""", """
SELECT d_date_sk, CAST(d_date + 10 AS DATE) AS a, CAST(d_date - 10 AS DATE) AS s, CAST(date_diff('day', d_date, DATE '2003-12-31') AS INT) AS df, CAST(d_date + INTERVAL 1 MONTH AS DATE) AS am, last_day(d_date) AS ld, CAST(d_date + CAST((8 - isodow(d_date)) AS INT) AS DATE) AS nd,
 CAST(date_trunc('month', d_date) AS DATE) AS tm, CAST(date_trunc('year', d_date) AS DATE) AS ty, CAST(date_diff('day', DATE '1970-01-01', d_date) AS INT) AS ud, d_date AS fu, make_date(year(d_date), 1, 1) AS md, strftime(d_date, '%Y/%m/%d') AS f, DATE '2001-02-03' AS td,
 CAST(d_date + INTERVAL 1 MONTH AS DATE) AS im, round((year(d_date) - 2000) * 12 + month(d_date) - 1 + (day(d_date) - 1) / 31.0::DOUBLE, 4) AS mb FROM {date_dim}""")
sql("fn_timestamps", """
SELECT event_id, date_trunc('hour', ts) AS th, date_trunc('month', ts) AS tm, unix_seconds(CAST(ts AS TIMESTAMP)) AS us, unix_millis(CAST(ts AS TIMESTAMP)) AS um, unix_micros(CAST(ts AS TIMESTAMP)) AS uu, ts + INTERVAL '2' HOUR AS ih, CAST(ts AS DATE) AS d,
 hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM {events}""", """
SELECT event_id, date_trunc('hour', ts) AS th, date_trunc('month', ts) AS tm, CAST(floor(epoch(ts)) AS BIGINT) AS us, epoch_us(ts) // 1000 AS um, epoch_us(ts) AS uu, ts + INTERVAL 2 HOUR AS ih, CAST(ts AS DATE) AS d,
 CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s FROM {events}""")
_NTZ = "CAST({} AS TIMESTAMP_NTZ) AS {}"
sql("fn_timestamps_more", "SELECT event_id, " + ", ".join(_NTZ.format(e, n) for n, e in {
    "ts1": "timestamp_seconds(unix_seconds(t))", "ts2": "timestamp_millis(unix_millis(t))", "ts3": "timestamp_micros(unix_micros(t))", "tz1": "to_utc_timestamp(t, 'Asia/Tokyo')", "tz2": "from_utc_timestamp(t, 'Asia/Tokyo')",
    "mt": "make_timestamp(2024, 1, 2, 3, 4, 5.5)", "ta": "timestampadd(DAY, 2, t)", "tt": "to_timestamp('2024-01-02', 'yyyy-MM-dd')", "ts4": "timestamp('2024-01-02 03:04:05')", "wb": "window(t, '10 minutes').start"}.items()) + """,
 from_unixtime(unix_seconds(t), 'yyyy-MM-dd HH:mm') AS fu, unix_timestamp(t) AS ut, to_unix_timestamp(date_format(t, 'yyyy-MM-dd HH:mm:ss')) AS tu, CAST(make_ym_interval(1, 2) AS STRING) AS ym, CAST(make_dt_interval(1, 2, 3, 4.5) AS STRING) AS dt,
 CAST(timestampdiff(HOUR, t, timestampadd(DAY, 2, t)) AS INT) AS td, dayname(t) AS dn, date_part('YEAR', t) AS dy, date_part('doy', t) AS dd, date_part('MINUTE', t) AS dm FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS t FROM {events}) e""", """
SELECT event_id, date_trunc('second', ts) AS ts1, date_trunc('millisecond', ts) AS ts2, CAST(ts AS TIMESTAMP) AS ts3, ts - INTERVAL 9 HOUR AS tz1, ts + INTERVAL 9 HOUR AS tz2, TIMESTAMP '2024-01-02 03:04:05.5' AS mt, ts + INTERVAL 2 DAY AS ta,
 TIMESTAMP '2024-01-02' AS tt, TIMESTAMP '2024-01-02 03:04:05' AS ts4, time_bucket(INTERVAL '10 minutes', ts) AS wb, strftime(ts, '%Y-%m-%d %H:%M') AS fu, CAST(floor(epoch(ts)) AS BIGINT) AS ut, CAST(floor(epoch(ts)) AS BIGINT) AS tu,
 'INTERVAL ''1-2'' YEAR TO MONTH' AS ym, 'INTERVAL ''1 02:03:04.5'' DAY TO SECOND' AS dt, 48 AS td, strftime(ts, '%a') AS dn, CAST(year(ts) AS INT) AS dy, CAST(dayofyear(ts) AS INT) AS dd, CAST(minute(ts) AS INT) AS dm FROM events""")

# --- JSON and hashes ---------------------------------------------------------------------------------------------------
sql("fn_json", """
SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS g, from_json(props, 'k INT').k AS f, to_json(named_struct('a', event_id)) AS t, json_array_length('[1,2,3]') AS al, json_object_keys(props) AS ok FROM {events}""", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS g, CAST(json_extract_string(props, '$.k') AS INT) AS f, '{"a":' || event_id || '}' AS t, 3 AS al, json_keys(props) AS ok FROM events""")
sql("fn_hash_standard", "SELECT p_partkey, md5(p_name) AS m, sha1(p_name) AS s1, sha2(p_name, 256) AS s2, sha(p_name) AS s FROM {part}", "SELECT p_partkey, md5(p_name) AS m, sha1(p_name) AS s1, sha256(p_name) AS s2, sha1(p_name) AS s FROM {part}")
# Values that Spark's documentation and the standards of the functions give.
_HASHES = {"h": ("hash('Spark', array(123), 2)", "-1321691492"), "x": ("xxhash64('Spark', array(123), 2)", "5602566077635097486"), "c": ("crc32('123456789')", "3421780262"), "c2": ("crc32('Spark')", "1557323817"),
           "s5": ("sha2('abc', 512)", "'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f'")}
sql("fn_hash_engine", f"SELECT count(*) AS n, count(DISTINCT xxhash64(p_partkey)) AS xs, count(DISTINCT hash(p_partkey)) AS hs, {', '.join(f'max({e}) AS {n}' for n, (e, _) in _HASHES.items())} FROM {{part}}",
    f"SELECT count(*) AS n, count(DISTINCT p_partkey) AS xs, count(DISTINCT p_partkey) AS hs, {', '.join(f'{v} AS {n}' for n, (_, v) in _HASHES.items())} FROM part")

# --- arrays, maps, structs ---------------------------------------------------------------------------------------------
_ARR = "(SELECT n_nationkey AS k, array(n_nationkey, n_regionkey, 3, 3, NULL) AS a, array(3, n_regionkey) AS b FROM {nation}) t"
_ARRD = "(SELECT n_nationkey AS k, [n_nationkey, n_regionkey, 3, 3, NULL] AS a, [3, n_regionkey] AS b FROM {nation}) t"
sql("fn_array_basic", f"""
SELECT k, size(a) AS n, element_at(a, 2) AS e, a[0] AS g, get(a, 9) AS ge, array_contains(b, 3) AS c, array_position(b, 3) AS p, array_max(a) AS mx, array_min(a) AS mn, slice(a, 2, 3) AS sl, concat(a, b) AS cc, flatten(array(a, b)) AS fl, array_repeat(k, 2) AS rp,
 sequence(1, 3) AS sq, array_join(b, '-') AS j, reverse(b) AS rv, array_compact(a) AS co, array_append(b, 7) AS ap, array_prepend(b, 7) AS pp FROM {_ARR}""", f"""
SELECT k, CAST(len(a) AS INT) AS n, a[2] AS e, a[1] AS g, NULL AS ge, list_contains(b, 3) AS c, CAST(list_position(b, 3) AS BIGINT) AS p, list_max(a) AS mx, list_min(a) AS mn, a[2:4] AS sl, list_concat(a, b) AS cc, flatten([a, b]) AS fl, [k, k] AS rp,
 [1, 2, 3] AS sq, array_to_string(b, '-') AS j, list_reverse(b) AS rv, list_filter(a, lambda x: x IS NOT NULL) AS co, list_append(b, 7) AS ap, list_prepend(7, b) AS pp FROM {_ARRD}""")
sql("fn_array_sets", f"""
SELECT k, sort_array(array_distinct(b)) AS d, sort_array(array_union(b, array(9))) AS u, sort_array(array_intersect(b, array(3, 1))) AS i, sort_array(array_except(b, array(3))) AS ex, array_remove(b, 3) AS r, arrays_overlap(b, array(3)) AS o, sort_array(b, false) AS sd, array_sort(b) AS s FROM {_ARR}""", f"""
SELECT k, list_sort(list_distinct(b)) AS d, list_sort(list_distinct(list_concat(b, [9]))) AS u, list_sort(list_intersect(b, [3, 1])) AS i, list_sort(list_distinct(list_filter(b, lambda x: x <> 3))) AS ex, list_filter(b, lambda x: x <> 3) AS r, list_has_any(b, [3]) AS o, list_reverse_sort(b) AS sd, list_sort(b) AS s FROM {_ARRD}""")
sql("fn_array_lambda", f"""
SELECT k, transform(b, x -> x * 2) AS t, filter(b, x -> x > 1) AS f, aggregate(b, 0, (acc, x) -> acc + x) AS ag, exists(b, x -> x = 3) AS ex, forall(b, x -> x >= 0) AS fa, zip_with(b, b, (x, y) -> x + y) AS zw, transform(b, (x, i) -> x + i) AS ti, reduce(b, 0, (acc, x) -> acc + x) AS rd FROM {_ARR}""", f"""
SELECT k, list_transform(b, lambda x: x * 2) AS t, list_filter(b, lambda x: x > 1) AS f, CAST(list_sum(b) AS INT) AS ag, len(list_filter(b, lambda x: x = 3)) > 0 AS ex, len(list_filter(b, lambda x: x < 0)) = 0 AS fa, list_transform(b, lambda x: x + x) AS zw, [b[1], b[2] + 1] AS ti, CAST(list_sum(b) AS INT) AS rd FROM {_ARRD}""")
sql("fn_array_more", f"""
SELECT k, transform(arrays_zip(a, b), x -> concat(coalesce(CAST(x.a AS STRING), '-'), '/', coalesce(CAST(x.b AS STRING), '-'))) AS z, sort_array(shuffle(b)) AS sh, array_insert(b, 1, 8L) AS ins, array_insert(b, -1, 8L) AS ine, array_size(b) AS sz, transform(arrays_zip(a, b), x -> x.b) AS zf, cardinality(b) AS ca,
 array_sort(b, (x, y) -> CAST(y - x AS INT)) AS so FROM {_ARR}""", f"""
SELECT k, list_transform(list_zip(a, b), lambda x: coalesce(CAST(x[1] AS VARCHAR), '-') || '/' || coalesce(CAST(x[2] AS VARCHAR), '-')) AS z, list_sort(b) AS sh, list_prepend(8, b) AS ins, list_append(b, 8) AS ine, CAST(len(b) AS INT) AS sz, list_transform(list_zip(a, b), lambda x: x[2]) AS zf, CAST(len(b) AS INT) AS ca,
 list_reverse_sort(b) AS so FROM {_ARRD}""")
sql("fn_array_vectors", """
SELECT vec_id, round(sqrt(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0.0D, (a, x) -> a + x)), 4) AS norm, size(embedding) AS n, round(CAST(array_max(embedding) AS DOUBLE), 5) AS hi FROM {embeddings}""", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, CAST(len(embedding) AS INT) AS n, round(CAST(list_max(embedding) AS DOUBLE), 5) AS hi FROM {embeddings}""")
sql("fn_map", """
SELECT k, map_keys(m) AS ks, map_values(m) AS vs, m['a'] AS g, element_at(m, 'b') AS e, map_contains_key(m, 'a') AS c, size(m) AS n, transform_values(m, (x, y) -> y + 1)['a'] AS tv, map_keys(transform_keys(m, (x, y) -> upper(x))) AS tk, map_keys(map_filter(m, (x, y) -> y > 2)) AS mf,
 map_zip_with(m, m, (x, y, z) -> y + z)['b'] AS mz, map_from_arrays(array('p', 'q'), array(1, 2))['q'] AS fa, str_to_map('a:1,b:2')['b'] AS sm, transform(map_entries(m), x -> x.value) AS me, map_concat(m, map('z', 9))['z'] AS mc FROM (SELECT n_nationkey AS k, map('a', n_nationkey, 'b', n_regionkey) AS m FROM {nation}) t""", """
SELECT k, ['a', 'b'] AS ks, [x, y] AS vs, x AS g, y AS e, true AS c, 2 AS n, x + 1 AS tv, ['A', 'B'] AS tk, list_concat(CASE WHEN x > 2 THEN ['a'] ELSE [] END, CASE WHEN y > 2 THEN ['b'] ELSE [] END) AS mf, y + y AS mz, 2 AS fa, '2' AS sm, [x, y] AS me, 9 AS mc
FROM (SELECT n_nationkey AS k, n_nationkey AS x, n_regionkey AS y FROM {nation}) t""")
sql("fn_struct", "SELECT n_nationkey, s.name AS nm, s.pair.a AS pa, transform(array(s), x -> x.name) AS sn FROM (SELECT n_nationkey, named_struct('name', n_name, 'pair', struct(n_regionkey AS a, 1 AS b)) AS s FROM {nation}) t",
    "SELECT n_nationkey, n_name AS nm, n_regionkey AS pa, [n_name] AS sn FROM {nation}")
sql("fn_misc", "SELECT count(*) AS n, count(DISTINCT m) AS ids, max(p) < 1000 AS few, max(length(v)) > 0 AS ver, max(t) AS t FROM (SELECT monotonically_increasing_id() AS m, spark_partition_id() AS p, version() AS v, typeof(o_orderkey) AS t FROM {orders}) x",
    "SELECT count(*) AS n, count(*) AS ids, true AS few, true AS ver, 'bigint' AS t FROM {orders}")
sql("fn_at_least_non_nulls", "SELECT ss_ticket_number, ss_item_sk, size(filter(array(ss_quantity, ss_promo_sk, ss_store_sk), x -> x IS NOT NULL)) >= 2 AS two FROM {store_sales}",
    "SELECT ss_ticket_number, ss_item_sk, (ss_quantity IS NOT NULL)::INT + (ss_promo_sk IS NOT NULL)::INT + (ss_store_sk IS NOT NULL)::INT >= 2 AS two FROM {store_sales}")
sql("fn_xml_csv", "SELECT n_nationkey, xpath_int(concat('<a><b>', n_nationkey, '</b></a>'), 'a/b') AS x, from_csv(concat(n_nationkey, ',', n_name), 'k INT, n STRING').n AS c, to_csv(struct(n_nationkey, n_name)) AS t FROM {nation}",
    "SELECT n_nationkey, n_nationkey AS x, n_name AS c, n_nationkey || ',' || n_name AS t FROM {nation}")
sql("fn_raise_error_guarded", "SELECT n_nationkey, CASE WHEN n_nationkey < 0 THEN raise_error('negative') ELSE n_name END AS n FROM {nation}", "SELECT n_nationkey, n_name AS n FROM {nation}")
sql("fn_rare", """
SELECT n_nationkey, xpath_string(x, 'a/b') AS xs, xpath_boolean(x, 'a/b') AS xb, xpath_double(x, 'a/b') AS xd, CAST(xpath_float(x, 'a/b') AS DOUBLE) AS xf, xpath_long(x, 'a/b') AS xl, CAST(xpath_short(x, 'a/b') AS INT) AS xh, xpath_number(x, 'a/b') AS xn, xpath(x, 'a/b/text()') AS xa,
 schema_of_csv('1,a') AS sc, schema_of_json('[1, 2]') AS sj, reflect('java.lang.Math', 'abs', -n_nationkey) AS rf, java_method('java.lang.Math', 'max', n_nationkey, 3) AS jm, CAST(make_interval(0, 0, 0, 1) AS STRING) AS mi,
 map_from_entries(array(struct('a', n_regionkey)))['a'] AS me FROM (SELECT *, concat('<a><b>', n_nationkey, '</b></a>') AS x FROM {nation}) t""", """
SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS xs, true AS xb, CAST(n_nationkey AS DOUBLE) AS xd, CAST(n_nationkey AS DOUBLE) AS xf, CAST(n_nationkey AS BIGINT) AS xl, CAST(n_nationkey AS INT) AS xh, CAST(n_nationkey AS DOUBLE) AS xn, [CAST(n_nationkey AS VARCHAR)] AS xa,
 'STRUCT<_c0: INT, _c1: STRING>' AS sc, 'ARRAY<BIGINT>' AS sj, CAST(n_nationkey AS VARCHAR) AS rf, CAST(greatest(n_nationkey, 3) AS VARCHAR) AS jm, '1 days' AS mi, n_regionkey AS me FROM nation""")
sql("fn_rare_aggregates", """
SELECT approx_percentile(l_quantity, 0.5) BETWEEN percentile(l_quantity, 0.49) AND percentile(l_quantity, 0.51) AS p, length(count_min_sketch(l_partkey, 0.1D, 0.9D, 1)) > 0 AS c, any_value(l_linenumber) BETWEEN min(l_linenumber) AND max(l_linenumber) AS a,
 round(try_avg(l_quantity), 6) AS ta, round(try_sum(l_quantity), 2) AS ts FROM {lineitem}""", "SELECT true AS p, true AS c, true AS a, round(avg(l_quantity), 6) AS ta, round(sum(l_quantity), 2) AS ts FROM {lineitem}")
sql("gen_inline_outer", "SELECT k, a, b FROM (SELECT n_nationkey AS k, IF(n_nationkey < 3, array(struct(n_name AS a, 1 AS b)), NULL) AS s FROM {nation}) t LATERAL VIEW OUTER inline(s) x", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 3 THEN n_name END AS a, CASE WHEN n_nationkey < 3 THEN 1 END AS b FROM {nation}")
sql("fn_decimal_overflow", "SELECT r_regionkey, try_cast(CAST('99999999999999999999999999999999999999' AS DECIMAL(38,0)) AS DECIMAL(10,0)) AS o, try_cast('x' AS INT) AS t, try_add(9223372036854775807L, CAST(r_regionkey + 1 AS BIGINT)) AS a FROM {region}",
    "SELECT r_regionkey, CAST(NULL AS DECIMAL(10,0)) AS o, CAST(NULL AS INT) AS t, CAST(NULL AS BIGINT) AS a FROM {region}")


@query("""
SELECT ss_ticket_number, ss_item_sk, (ss_quantity IS NOT NULL)::INT + (ss_promo_sk IS NOT NULL)::INT + (ss_store_sk IS NOT NULL)::INT >= 2 AS two, CAST(ss_sales_price * 100 AS BIGINT) AS digits, ss_sales_price AS back FROM store_sales""")
def fn_internal_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Non-null counts, digits of decimals and back."""
    x = table(spark, d, "store_sales").select("ss_ticket_number", "ss_item_sk", columns.at_least_n_non_nulls(2, "ss_quantity", "ss_promo_sk", "ss_store_sk").alias("two"), columns.unscaled_value("ss_sales_price", 2).alias("digits"))
    return x.withColumn("back", columns.make_decimal("digits", 7, 2))


@query("SELECT n_regionkey, n_name FROM nation, range(25) r(i) WHERE i < n_nationkey % 3")
def gen_replicate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows repeated by a column."""
    x = table(spark, d, "nation").select("n_regionkey", "n_name", (F.col("n_nationkey") % 3).alias("times"))
    return columns.replicate_rows(x, "times")


@query("SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY 1")
def fn_array_struct_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field of an array of structs."""
    x = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("s"))
    return x.select("n_regionkey", columns.array_fields("s", "n_name").alias("names"))
