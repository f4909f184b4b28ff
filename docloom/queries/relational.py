"""The relational surface that guarded SQL reaches: joins, aggregates, windows, set operations, subqueries, time."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import Registry, sql_query

REGISTRY = R = Registry()

R.sql("join_inner", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000")
R.sql("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey")
R.sql("join_right", "SELECT n.n_name, count(s.s_suppkey) AS n FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0 GROUP BY n.n_name")
R.sql("join_full_outer", "SELECT e.vec_id, d.doc_id, e.label, d.lang FROM embeddings e FULL OUTER JOIN documents d ON e.vec_id = d.doc_id")
R.sql("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
R.sql("join_semi", "SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
R.sql("join_anti", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
R.sql("subq_exists", "SELECT p_partkey, p_name FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
R.sql("subq_not_exists", "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount > 0.09 AND l.l_quantity > 49)")
R.sql("subq_scalar_corr", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top_price FROM customer c")
R.sql("subq_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_totalprice > 150000")
R.sql("lateral_join", "SELECT n.n_name, s.s_suppkey, s.s_acctbal FROM nation n, LATERAL (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) s")
R.sql("join_range", "SELECT p.p_partkey, b.name FROM part p JOIN (VALUES ('small', 1, 15), ('mid', 16, 35), ('big', 36, 60)) AS b(name, lo, hi) ON p.p_size BETWEEN b.lo AND b.hi")
R.sql("join_interval", """
SELECT a.event_id AS first_id, b.event_id AS next_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE
""")
R.sql("join_asof", """
WITH u AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS q, CASE WHEN event_type = 'view' THEN value END AS v, CASE WHEN event_type = 'view' THEN 1 END AS isv FROM events WHERE event_type IN ('purchase', 'view')),
w AS (SELECT *, last(v, true) OVER (PARTITION BY user_id ORDER BY ts, q, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS view_value FROM u)
SELECT event_id, view_value FROM w WHERE q = 1""", """
WITH u AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS q, CASE WHEN event_type = 'view' THEN value END AS v FROM events WHERE event_type IN ('purchase', 'view')),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, q, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS view_value FROM u)
SELECT event_id, view_value FROM w WHERE q = 1""")
R.sql("agg_group", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
R.sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")
R.sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM orders GROUP BY o_orderpriority")
R.sql("agg_having", "SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150")
R.sql("agg_grouping_sets", "SELECT n_regionkey, s_nationkey, grouping(n_regionkey) AS g1, grouping(s_nationkey) AS g2, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey), (s_nationkey), ())")
R.sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
R.sql("agg_rollup", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
R.sql("agg_percentile", "SELECT c_mktsegment, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal), 4) AS p90 FROM customer GROUP BY c_mktsegment")
R.sql("agg_median", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS med FROM lineitem GROUP BY l_returnflag")
R.sql("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_orderstatus = 'F') AS any_f FROM orders GROUP BY o_custkey")
R.sql("agg_string", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
R.sql("agg_max_by", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS top_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS top_order FROM orders GROUP BY o_custkey")
R.sql("agg_collect", "SELECT n_regionkey, array_join(array_sort(collect_list(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
R.sql("agg_stats", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS cr FROM lineitem GROUP BY l_returnflag")
R["agg_approx_distinct"] = (sql_query("SELECT approx_count_distinct(l_partkey) AS parts FROM lineitem"), None)
R.sql("win_rank", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
R.sql("win_ntile", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS q FROM part")
R.sql("win_lag_lead", "SELECT event_id, lag(event_id) OVER w AS prev_id, lead(event_id, 2) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
R.sql("win_nth", "SELECT event_id, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id FROM events")
R.sql("win_rows_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS ma FROM events")
R.sql("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND CURRENT ROW) AS n FROM orders")
R.sql("win_topn_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3")
R.sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
R.sql("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
R.sql("set_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
R.sql("set_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
R.sql("set_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
R.sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
R.sql("set_except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
R.sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
R.sql("pivot_case", "SELECT o_orderstatus, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent, sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS low FROM orders GROUP BY o_orderstatus")
R.sql("unpivot", "SELECT p_partkey, k, v FROM part LATERAL VIEW stack(2, 'size', CAST(p_size AS DOUBLE), 'price', p_retailprice) s AS k, v", "SELECT p_partkey, 'size' AS k, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
R.sql("date_trunc_agg", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1")
R.sql("date_parts", "SELECT extract(year FROM l_shipdate) AS y, extract(month FROM l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2")
R.sql("date_interval", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY")
R.sql("win_tumbling", "SELECT window.start AS start_ts, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 day'), event_type", "SELECT date_trunc('day', ts) AS start_ts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
R.sql("win_sliding", "SELECT window.start AS start_ts, count(*) AS n FROM events GROUP BY window(ts, '2 days', '1 day')", "SELECT start_ts, count(*) AS n FROM (SELECT date_trunc('day', ts) - i * INTERVAL 1 DAY AS start_ts FROM events, (VALUES (0), (1)) v(i)) GROUP BY 1")
R.sql("win_session", "SELECT user_id, session_window.start AS start_ts, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM s GROUP BY user_id, sid""")
R.sql("json_props", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
R.sql("json_schema", "SELECT event_id, from_json(props, 'k INT').k AS k FROM events", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
R.sql("map_merge", "SELECT n_nationkey, m['a'] AS a, m['b'] AS b, size(m) AS n FROM (SELECT n_nationkey, map_concat(map('a', n_nationkey), map('b', n_regionkey)) AS m FROM nation)", "SELECT n_nationkey, m['a'] AS a, m['b'] AS b, cardinality(m)::INT AS n FROM (SELECT n_nationkey, map_concat(MAP {'a': n_nationkey}, MAP {'b': n_regionkey}) AS m FROM nation)")
R["struct_fields"] = (
    lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("x")).select("n_nationkey", F.col("x").withField("n_regionkey", F.col("x.n_regionkey") + 1).withField("flag", F.lit(True)).dropFields("n_name").alias("x")).select("n_nationkey", "x.*"),
    "SELECT n_nationkey, n_regionkey + 1 AS n_regionkey, true AS flag FROM nation",
)
R.sql("str_funcs", "SELECT c_custkey, upper(substring(c_name, 1, 5)) AS u, replace(c_name, '#', '-') AS r, length(c_name) AS n, lower(c_mktsegment) AS l, concat(c_mktsegment, '/', CAST(c_nationkey AS STRING)) AS c FROM customer", "SELECT c_custkey, upper(substring(c_name, 1, 5)) AS u, replace(c_name, '#', '-') AS r, length(c_name) AS n, lower(c_mktsegment) AS l, concat(c_mktsegment, '/', CAST(c_nationkey AS VARCHAR)) AS c FROM customer")
R.sql("math_funcs", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS s, floor(p_retailprice) AS f, p_size % 7 AS m, round(ln(p_retailprice), 6) AS l, greatest(p_size, 10) AS g FROM part")
R.sql("case_cast", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) AS z, coalesce(nullif(o_orderstatus, 'F'), '-') AS st FROM orders")
R.sql("tpch_like", """
SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE l.l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY n.n_name""")
