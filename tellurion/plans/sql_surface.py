"""The SQL that any user statement may use, one query for each family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurion.functions.text import gcd, iszero, lcm
from tellurion.plans.registry import query, sql_query
from tellurion.sources.signals import read

D = "DECIMAL(18,2)"

sql_query("sql_inner_join", f"SELECT n_name, count(*) AS n, sum(CAST(o_totalprice AS {D})) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
sql_query("sql_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
sql_query("sql_right_join", "SELECT r_name, count(n_nationkey) AS n FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 10 GROUP BY r_name")
sql_query("sql_full_join", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 8) b ON a.k = b.k")
sql_query("sql_cross_join", "SELECT count(*) AS n FROM region a CROSS JOIN nation b")
sql_query("sql_self_join", "SELECT a.event_type, count(*) AS n FROM events a JOIN events b ON a.event_id = b.event_id + 1 AND a.event_type = b.event_type GROUP BY a.event_type")
sql_query("sql_semi_join", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
sql_query("sql_anti_join", "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql_query("sql_theta_join", "SELECT r.r_name, count(*) AS n FROM region r JOIN nation n ON n.n_nationkey BETWEEN r.r_regionkey * 5 AND r.r_regionkey * 5 + 7 GROUP BY 1")
sql_query("sql_lateral", "SELECT r_name, t.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) t")
sql_query("sql_in_subquery", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
sql_query("sql_scalar_subquery", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql_query("sql_correlated", "SELECT count(*) AS n FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
sql_query("sql_cte", "WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT max(n) AS m FROM a) SELECT l_suppkey, n FROM a JOIN b ON n = m")
sql_query("sql_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
sql_query("sql_values", "SELECT b, sum(a) AS s FROM (VALUES (1, 'x'), (2, 'y'), (3, 'x')) t(a, b) GROUP BY b")
sql_query("sql_unnest", "SELECT event_id, x FROM events LATERAL VIEW explode(array(event_id, user_id)) v AS x", "SELECT event_id, unnest([event_id, user_id]) AS x FROM events")
sql_query("sql_aggregates", f"SELECT l_returnflag, count(*) AS n, sum(CAST(l_extendedprice AS {D})) AS total, min(l_shipdate) AS first, max(l_shipdate) AS last, round(avg(l_quantity), 6) AS mean, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
sql_query(
    "sql_statistics",
    "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, regr_count(l_quantity, l_tax) AS n, round(median(l_quantity), 6) AS med, round(skewness(l_quantity), 4) AS sk FROM lineitem GROUP BY 1",
    "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, CAST(regr_count(l_quantity, l_tax) AS BIGINT) AS n, round(median(l_quantity), 6) AS med, round((sum(power(l_quantity - m, 3)) / count(*)) / power(var_pop(l_quantity), 1.5), 4) AS sk FROM lineitem JOIN (SELECT l_returnflag AS f, avg(l_quantity) AS m FROM lineitem GROUP BY 1) ON f = l_returnflag GROUP BY 1",
)
sql_query(
    "sql_boolean_bit_aggregates",
    "SELECT event_type, bool_and(value > 1) AS a, bool_or(value > 100) AS o, bit_and(user_id) AS ba, bit_or(user_id) AS bo, bit_xor(event_id) AS bx FROM events GROUP BY 1",
)
sql_query(
    "sql_collect",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, array_join(array_sort(array_agg(CAST(n_nationkey AS STRING))), ' ') AS keys, first_value(n_regionkey) AS fv FROM nation GROUP BY 1",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, array_to_string(list_sort(array_agg(CAST(n_nationkey AS VARCHAR))), ' ') AS keys, first(n_regionkey) AS fv FROM nation GROUP BY 1",
)
sql_query("sql_filter_clause", "SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0) AS even, count(DISTINCT user_id) FILTER (WHERE value > 50) AS users FROM events GROUP BY 1")
sql_query("sql_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > (SELECT 1.1 * count(*) / count(DISTINCT l_suppkey) FROM lineitem)")
sql_query("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql_query("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql_query("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql_query(
    "sql_window_rank",
    "SELECT event_id, row_number() OVER w AS rn, rank() OVER v AS r, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id), v AS (PARTITION BY event_type ORDER BY user_id)",
    "SELECT event_id, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER v AS INT) AS r, CAST(dense_rank() OVER v AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS nt, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id), v AS (PARTITION BY event_type ORDER BY user_id)",
)
sql_query("sql_window_analytic", "SELECT event_id, lag(event_id, 2) OVER w AS l2, lead(event_id, 1, -1) OVER w AS ld, first_value(event_id) OVER w AS fv, last_value(event_id) OVER w AS lv, nth_value(event_id, 3) OVER w AS n3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
sql_query(
    "sql_window_frames",
    "SELECT event_id, sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s, count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS c FROM events",
    "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS c FROM events",
)
sql_query(
    "sql_window_groups",
    "SELECT event_id, sum(event_id) OVER (PARTITION BY event_type ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS g FROM events)",
    "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events",
)
sql_query("sql_qualify", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
sql_query("sql_setops_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
sql_query("sql_setops_union_all", "SELECT k, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) GROUP BY k")
sql_query("sql_setops_intersect", "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
sql_query("sql_setops_intersect_all", "SELECT n_regionkey FROM nation INTERSECT ALL SELECT n_regionkey FROM nation WHERE n_nationkey < 12")
sql_query("sql_setops_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
sql_query("sql_setops_except_all", "SELECT n_regionkey FROM nation EXCEPT ALL SELECT n_regionkey FROM nation WHERE n_nationkey < 12")
sql_query("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
sql_query("sql_nulls_order", "SELECT k FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS k FROM nation) ORDER BY k ASC NULLS LAST LIMIT 10")
sql_query("sql_predicates", "SELECT count(*) AS n FROM part WHERE p_name LIKE '%ring' AND p_brand NOT IN ('Brand#1', 'Brand#2') AND p_size BETWEEN 5 AND 30 AND p_type IS DISTINCT FROM 'PROMO' AND (CASE WHEN p_size > 10 THEN 1 ELSE 0 END) = 1 AND p_name ILIKE '%RING%'")
sql_query(
    "sql_regexp",
    "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS r, regexp_extract(p_brand, '#([0-9]+)', 1) AS e, regexp_count(p_name, '[a-e]') AS c, regexp_like(p_name, '^s') AS l, regexp_instr(p_name, ' ') AS i FROM part",
    "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, regexp_extract(p_brand, '#([0-9]+)', 1) AS e, CAST(len(regexp_extract_all(p_name, '[a-e]')) AS INT) AS c, regexp_matches(p_name, '^s') AS l, CAST(strpos(p_name, ' ') AS INT) AS i FROM part",
)
sql_query(
    "sql_string",
    "SELECT p_partkey, ascii(p_name) AS a, bit_length(p_name) AS bl, btrim(concat(' ', p_name, ' ')) AS bt, chr(65 + p_size % 26) AS ch, concat_ws('-', p_name, p_brand) AS cw, endswith(p_name, 'g') AS ew, startswith(p_name, 's') AS sw, initcap(p_name) AS ic, instr(p_name, 'i') AS ins, left(p_name, 3) AS lf, right(p_name, 3) AS rt, length(p_name) AS ln, levenshtein(p_name, 'small ring') AS lv, lpad(p_name, 14, '*') AS lp, rpad(p_name, 14, '*') AS rp FROM part",
    "SELECT p_partkey, ascii(p_name) AS a, CAST(bit_length(p_name) AS INT) AS bl, trim(concat(' ', p_name, ' ')) AS bt, chr(65 + p_size % 26) AS ch, concat_ws('-', p_name, p_brand) AS cw, ends_with(p_name, 'g') AS ew, starts_with(p_name, 's') AS sw, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS ic, CAST(instr(p_name, 'i') AS INT) AS ins, left(p_name, 3) AS lf, right(p_name, 3) AS rt, CAST(length(p_name) AS INT) AS ln, CAST(levenshtein(p_name, 'small ring') AS INT) AS lv, lpad(p_name, 14, '*') AS lp, rpad(p_name, 14, '*') AS rp FROM part",
)
sql_query(
    "sql_string_more",
    "SELECT p_partkey, octet_length(p_name) AS ol, overlay(p_name PLACING 'XX' FROM 2 FOR 3) AS ov, position('r' IN p_name) AS ps, repeat(p_brand, 2) AS rp, replace(p_name, 'r', 'R') AS rl, reverse(p_name) AS rv, split_part(p_name, ' ', 2) AS sp, substr(p_name, 2, 4) AS ss, substring_index(p_name, ' ', 1) AS si, lower(hex(p_partkey)) AS hx, translate(p_name, 'aei', '123') AS tr, upper(p_name) AS up, lower(p_type) AS lo, find_in_set('b', 'a,b,c') AS fs, ltrim(concat('  ', p_name)) AS lt FROM part",
    "SELECT p_partkey, CAST(octet_length(encode(p_name)) AS INT) AS ol, left(p_name, 1) || 'XX' || substr(p_name, 5) AS ov, CAST(position('r' IN p_name) AS INT) AS ps, repeat(p_brand, 2) AS rp, replace(p_name, 'r', 'R') AS rl, reverse(p_name) AS rv, split_part(p_name, ' ', 2) AS sp, substr(p_name, 2, 4) AS ss, split_part(p_name, ' ', 1) AS si, lower(hex(p_partkey)) AS hx, translate(p_name, 'aei', '123') AS tr, upper(p_name) AS up, lower(p_type) AS lo, 2 AS fs, ltrim(concat('  ', p_name)) AS lt FROM part",
)
sql_query(
    "sql_math",
    "SELECT event_id, abs(-event_id) AS ab, CAST(ceil(value) AS BIGINT) AS ce, CAST(floor(value) AS BIGINT) AS fl, round(sqrt(value), 6) AS sq, round(cbrt(value), 6) AS cb, round(exp(value / 1000), 6) AS ex, round(ln(value + 1), 6) AS l, round(log10(value + 1), 6) AS l10, round(log2(value + 1), 6) AS l2, round(power(value, 1.5), 3) AS pw, round(sin(value), 6) AS sn, round(atan2(value, 2), 6) AS at, round(degrees(value), 3) AS dg, round(radians(value), 6) AS rd, sign(value) AS sg, event_id % 7 AS m, event_id div 7 AS dv, factorial(CAST(event_id % 10 AS INT)) AS fc, round(tanh(value / 100), 6) AS th, isnan(value) AS nn, nanvl(value, 0) AS nv, round(pi(), 6) AS pi FROM events",
    "SELECT event_id, abs(-event_id) AS ab, CAST(ceil(value) AS BIGINT) AS ce, CAST(floor(value) AS BIGINT) AS fl, round(sqrt(value), 6) AS sq, round(cbrt(value), 6) AS cb, round(exp(value / 1000), 6) AS ex, round(ln(value + 1), 6) AS l, round(log10(value + 1), 6) AS l10, round(log2(value + 1), 6) AS l2, round(power(value, 1.5), 3) AS pw, round(sin(value), 6) AS sn, round(atan2(value, 2), 6) AS at, round(degrees(value), 3) AS dg, round(radians(value), 6) AS rd, CAST(sign(value) AS DOUBLE) AS sg, event_id % 7 AS m, event_id // 7 AS dv, CAST(factorial(CAST(event_id % 10 AS INT)) AS BIGINT) AS fc, round(tanh(value / 100), 6) AS th, isnan(value) AS nn, value AS nv, round(pi(), 6) AS pi FROM events",
)
sql_query(
    "sql_date",
    "SELECT event_id, date_trunc('hour', ts) AS h, year(ts) AS y, extract(DOW FROM ts) - 1 AS dw, dayofyear(ts) AS dy, date_part('minute', ts) AS mi, CAST(ts AS DATE) AS d, make_date(2024, 1, 1 + CAST(event_id % 28 AS INT)) AS md, date_format(ts, 'yyyy/MM/dd HH') AS tc, ts + INTERVAL 90 MINUTES AS later, datediff(CAST(ts AS DATE), DATE '2024-01-01') AS dd, unix_timestamp(CAST(ts AS TIMESTAMP)) AS us, add_months(CAST(ts AS DATE), 2) AS am, last_day(CAST(ts AS DATE)) AS ld FROM events",
    "SELECT event_id, date_trunc('hour', ts) AS h, CAST(year(ts) AS INT) AS y, CAST(dayofweek(ts) AS INT) AS dw, CAST(dayofyear(ts) AS INT) AS dy, CAST(date_part('minute', ts) AS INT) AS mi, CAST(ts AS DATE) AS d, make_date(2024, 1, 1 + CAST(event_id % 28 AS INT)) AS md, strftime(ts, '%Y/%m/%d %H') AS tc, ts + INTERVAL 90 MINUTES AS later, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS dd, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS us, CAST(CAST(ts AS DATE) + INTERVAL 2 MONTHS AS DATE) AS am, last_day(CAST(ts AS DATE)) AS ld FROM events",
)
sql_query(
    "sql_conditional",
    "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS c, ifnull(nullif(user_id, 3), -1) AS i, nvl2(nullif(user_id, 3), 1, 0) AS n2, greatest(event_id, user_id) AS g, least(event_id, user_id, 10) AS l, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 END AS cs, CAST(value AS INT) = CAST(floor(value) AS INT) AS t FROM events",
    "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS c, ifnull(nullif(user_id, 3), -1) AS i, CASE WHEN nullif(user_id, 3) IS NOT NULL THEN 1 ELSE 0 END AS n2, greatest(event_id, user_id) AS g, least(event_id, user_id, 10) AS l, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 END AS cs, true AS t FROM events",
)
sql_query(
    "sql_array",
    "SELECT event_id, array_join(transform(a, x -> CAST(x AS STRING)), ',') AS s, size(a) AS n, array_contains(a, 3) AS h, array_position(a, 2) AS p, array_join(transform(slice(a, 2, 2), x -> CAST(x AS STRING)), ',') AS sl, array_max(a) AS mx, array_join(transform(array_distinct(concat(a, a)), x -> CAST(x AS STRING)), ',') AS di, size(array_intersect(a, array(1, 2))) AS it, size(array_except(a, array(1, 2))) AS ec, size(array_union(a, array(9))) AS un, size(flatten(array(a, a))) AS fl, size(array_remove(a, 1)) AS rm, size(array_append(a, 5)) AS ap, aggregate(a, 0, (x, y) -> x + y) AS sm FROM (SELECT event_id, sequence(1, 1 + CAST(event_id % 5 AS INT)) AS a FROM events)",
    "SELECT event_id, array_to_string(a, ',') AS s, CAST(len(a) AS INT) AS n, list_contains(a, 3) AS h, CAST(coalesce(list_position(a, 2), 0) AS BIGINT) AS p, array_to_string(a[2:3], ',') AS sl, list_max(a) AS mx, array_to_string(a, ',') AS di, CAST(len(list_intersect(a, [1, 2])) AS INT) AS it, CAST(len(a) - len(list_intersect(a, [1, 2])) AS INT) AS ec, CAST(len(a) + 1 AS INT) AS un, CAST(2 * len(a) AS INT) AS fl, CAST(len(a) - 1 AS INT) AS rm, CAST(len(a) + 1 AS INT) AS ap, CAST(list_sum(a) AS INT) AS sm FROM (SELECT event_id, CAST(range(1, 2 + CAST(event_id % 5 AS INT)) AS INT[]) AS a FROM events)",
)
sql_query(
    "sql_map_struct",
    "SELECT event_id, m['a'] AS a, m['zz'] AS z, size(m) AS n, array_join(array_sort(map_keys(m)), ',') AS k, array_join(array_sort(map_values(m)), ',') AS v, s.x AS sx, s.y AS sy FROM (SELECT event_id, map('a', event_type, 'b', CAST(user_id AS STRING)) AS m, named_struct('x', user_id, 'y', event_type) AS s FROM events)",
    "SELECT event_id, m['a'] AS a, m['zz'] AS z, CAST(cardinality(m) AS INT) AS n, array_to_string(list_sort(map_keys(m)), ',') AS k, array_to_string(list_sort(map_values(m)), ',') AS v, s.x AS sx, s.y AS sy FROM (SELECT event_id, MAP {'a': event_type, 'b': CAST(user_id AS VARCHAR)} AS m, {'x': user_id, 'y': event_type} AS s FROM events)",
)
sql_query(
    "sql_json",
    "SELECT event_id, get_json_object(props, '$.k') AS k, CAST(from_json(props, 'k INT').k AS INT) + 1 AS i, try_variant_get(parse_json(props), '$.k', 'int') AS v FROM events",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS INT) + 1 AS i, CAST(json_extract(props, '$.k') AS INT) AS v FROM events",
)
sql_query(
    "sql_hash_encoding",
    "SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s, base64(CAST(p_name AS BINARY)) AS b, CAST(unbase64(base64(CAST(p_name AS BINARY))) AS STRING) AS u, lower(hex(p_name)) AS h, CAST(unhex(hex(p_name)) AS STRING) AS uh FROM part",
    "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s, base64(encode(p_name)) AS b, p_name AS u, lower(hex(encode(p_name))) AS h, p_name AS uh FROM part",
)
sql_query("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql_query("sql_cast", "SELECT event_id, CAST(value AS BIGINT) - CAST(value AS BIGINT) AS z, CAST(event_id AS VARCHAR(20)) AS s, CAST('12' AS INT) + 1 AS i, try_cast('x' AS INT) AS t, CAST(event_id AS DECIMAL(10,2)) AS d FROM events")


@query("SELECT event_id, gcd(event_id, user_id) AS g, CAST(lcm(event_id, user_id) AS BIGINT) AS l, event_id = 0 AS z FROM events")
def sql_number_theory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gcd, lcm and iszero, which Spark SQL lacks, as expressions."""
    e = read(spark, sf_dir, "events")
    a, b = F.col("event_id"), F.col("user_id")
    return e.select("event_id", gcd(a, b, 40).alias("g"), lcm(a, b).alias("l"), iszero(a).alias("z"))


@query("SELECT e.event_id, (SELECT max(f.event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'click' AND f.event_id <= e.event_id) AS click FROM events e WHERE e.event_type = 'purchase'")
def asof_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click at or before each purchase of a user, by a window instead of a join."""
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = read(spark, sf_dir, "events").withColumn("click", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(order))
    return rows.filter("event_type = 'purchase'").select("event_id", "click")


@query("SELECT true AS near")
def sql_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether approximate aggregates come near the exact ones. Beside a distinct count Spark would keep the others' buffers for each distinct value, so it stands alone."""
    e = read(spark, sf_dir, "lineitem")
    distinct = e.select("l_partkey").distinct().agg(F.count("l_partkey").alias("d"))
    both = e.agg(F.approx_count_distinct("l_partkey", 0.02).alias("ad"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity)").alias("p"), F.percentile_approx("l_quantity", 0.9, 10000).alias("ap")).crossJoin(distinct)
    return both.select(((F.abs(F.col("ad") - F.col("d")) <= 0.1 * F.col("d")) & (F.abs(F.col("ap") - F.col("p")) <= 1)).alias("near"))
