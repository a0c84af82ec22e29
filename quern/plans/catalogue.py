"""The registered queries over the relational and vector operators, and their SQL.

A query is Spark SQL over the tables it names, or a function of (spark, sf_dir).
Where DuckDB spells something differently its own text is given.
"""

from __future__ import annotations

import re

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: name -> SQL that both engines run
BOTH: dict[str, str] = {
    # scans, projections, predicates
    "scan_all": "SELECT * FROM nation",
    "project_cols": "SELECT p_partkey, p_name, p_brand FROM part",
    "project_repeated_cols": "SELECT n_name, n_nationkey, n_name AS n_name_again FROM nation",
    "project_alias_const_arith": """SELECT p_partkey + 1 AS next_key, p_size * 2 AS doubled, CAST(1.5 AS DOUBLE) AS constant_value,
        'literal' AS u FROM part AS x""",
    "filter_eq": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "filter_lt": "SELECT o_orderkey FROM orders WHERE o_orderkey < 1000",
    "filter_gt": "SELECT o_orderkey FROM orders WHERE o_orderkey > 1000",
    "filter_le_ge": "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 200",
    "filter_reversed": "SELECT o_orderkey FROM orders WHERE 500 > o_orderkey",
    "filter_range_and": "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 20",
    "filter_or": "SELECT p_partkey FROM part WHERE p_partkey = 1 OR p_partkey = 3 OR p_brand = 'Brand#11'",
    "filter_ne": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1",
    "filter_in_between_like": """SELECT p_partkey, p_type FROM part
        WHERE p_size IN (1, 5, 9, 13) AND p_partkey BETWEEN 10 AND 1500 AND p_type LIKE '%E%'""",
    "filter_not_case_coalesce": """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS class,
        coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer WHERE NOT (c_nationkey = 3)""",
    "filter_null": """SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) t
        WHERE v IS NULL OR v > 50""",
    "filter_eq_null_is_empty": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = NULL",
    "filter_timestamp": "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01 00:00:00'",
    # index-shaped access
    "index_point_lookup": "SELECT * FROM orders WHERE o_orderkey = 77",
    "index_range_ordered": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 60 ORDER BY o_orderkey",
    "index_duplicates": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 42",
    # sorting and limits: ascending nulls last, descending nulls first
    "order_asc_nulls_last": """SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events) t
        ORDER BY v ASC NULLS LAST, event_id""",
    "order_desc_nulls_first": """SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events) t
        ORDER BY v DESC NULLS FIRST, event_id LIMIT 100""",
    "order_limit": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10",
    "order_limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20",
    "limit_zero": "SELECT c_custkey FROM customer LIMIT 0",
    "topk_multi_key": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        ORDER BY l_quantity DESC NULLS FIRST, l_orderkey ASC NULLS LAST, l_linenumber LIMIT 50""",
    # joins
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_inner_where_order": """SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_custkey = 7 ORDER BY o_orderkey""",
    "join_three_way": """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "join_full": """SELECT a.k AS ak, b.k AS bk FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey < 100) a
        FULL OUTER JOIN (SELECT s_suppkey AS k FROM supplier) b ON a.k = b.k""",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_cross": "SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a CROSS JOIN region b",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_using": "SELECT doc_id, toxic, lang FROM labels JOIN documents USING (doc_id)",
    "join_natural": "SELECT doc_id, quality, source FROM labels NATURAL JOIN documents",
    "join_self": "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey",
    "join_range": """SELECT e.event_id, b.lo FROM events e JOIN (SELECT CAST(s_suppkey * 10 AS DOUBLE) AS lo FROM supplier WHERE s_suppkey < 11) b
        ON e.value >= b.lo AND e.value < b.lo + 10""",
    # aggregation
    "agg_count": "SELECT count(*) AS n, count(o_custkey) AS n_cust FROM orders",
    "agg_count_empty": "SELECT count(*) AS n FROM orders WHERE o_orderkey < 0",
    "agg_sum_avg_min_max": """SELECT sum(CAST(l_quantity AS BIGINT)) AS sum_qty, round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first_ship,
        max(l_extendedprice) AS top_price FROM lineitem""",
    "group_by_having": """SELECT l_returnflag, l_linestatus, count(*) AS n_rows, sum(CAST(l_quantity AS BIGINT)) AS sum_qty
        FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1""",
    "agg_pricing_summary": """SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT)) AS sum_qty,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "select_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "agg_filter": """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 100000) AS big
        FROM orders GROUP BY o_orderpriority""",
    "agg_rollup": """SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS BIGINT) AS g
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": """SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer
        GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())""",
    "agg_stats": """SELECT o_orderstatus, round(stddev_samp(o_totalprice), 2) AS sd, round(stddev_pop(o_totalprice), 2) AS sdp,
        round(corr(o_totalprice, CAST(o_custkey AS DOUBLE)), 6) AS r, round(median(o_totalprice), 4) AS med FROM orders GROUP BY o_orderstatus""",
    "agg_regression": """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
        round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem""",
    "agg_bool_bit": """SELECT o_orderstatus, bool_and(o_totalprice > 0) AS all_pos, bool_or(o_totalprice > 300000) AS any_big,
        bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx FROM orders GROUP BY o_orderstatus""",
    # windows
    "win_rank": """SELECT event_id, event_type, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk,
        CAST(dense_rank() OVER w AS BIGINT) AS dr FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id)""".replace(
        "row_number() OVER w", "row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id)"
    ),
    "win_lag_lead": """SELECT event_id, lag(value) OVER w AS prev_value, lead(value, 2) OVER w AS next_value, first_value(value) OVER w AS first_v
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "win_last_nth": """SELECT event_id, last_value(event_id) OVER w AS last_id, nth_value(event_id, 2) OVER w AS second_id FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "win_running_sum": """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders""",
    "win_moving_range": """SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS near
        FROM orders""",
    "win_ntile_pct": """SELECT c_custkey, CAST(ntile(4) OVER w AS BIGINT) AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
        FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""",
    # set operations, subqueries, common tables
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "set_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey AS k FROM supplier",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey AS k FROM supplier",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "subq_scalar": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "subq_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)",
    "subq_not_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "subq_correlated_scalar": """SELECT o_orderkey FROM orders o WHERE o_totalprice =
        (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
    "cte": """WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big)
        SELECT o_custkey, n FROM big JOIN top ON n = m""",
    "cte_recursive": """WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20)
        SELECT n, n_name FROM t JOIN nation ON n = n_nationkey""",
    # scalar functions
    "fn_string": """SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS len, trim(concat(' ', p_type, ' ')) AS t,
        replace(p_name, 'a', 'X') AS rep, substr(p_type, 2, 4) AS sub, reverse(p_brand) AS rev, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp,
        left(p_name, 3) AS le, right(p_name, 3) AS ri, concat_ws('|', p_brand, p_type) AS cw, repeat('ab', 2) AS rp2,
        split_part(p_brand, '#', 2) AS sp, translate(p_brand, 'B#', 'b-') AS tr, ascii(p_name) AS asc1, chr(65) AS ch FROM part""",
    "fn_string_search": """SELECT p_partkey, contains(p_type, 'E') AS c, p_name ILIKE '%A%' AS il, regexp_replace(p_brand, '[0-9]', 'N') AS r1
        FROM part""".replace("regexp_replace(p_brand, '[0-9]', 'N')", "regexp_replace(p_brand, '[0-9]+', 'N')"),
    "fn_date": """SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m,
        CAST(extract(day FROM o_orderdate) AS BIGINT) AS d, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS q,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(o_orderdate AS DATE) AS day,
        CAST(o_orderdate + INTERVAL '1' DAY AS DATE) AS next_day FROM orders""",
    "fn_math": """SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl,
        round(sqrt(abs(c_acctbal)), 6) AS sq, round(ln(abs(c_acctbal) + 1), 6) AS l, round(log10(abs(c_acctbal) + 1), 6) AS l10,
        round(exp(0.5), 6) AS e, round(power(2.0, 3), 6) AS p, CAST(sign(c_acctbal) AS BIGINT) AS s, round(sin(1.0), 6) AS si, round(atan2(1.0, 2.0), 6) AS at,
        round(degrees(pi()), 4) AS deg, round(cbrt(27.0), 6) AS cb, c_custkey % 7 AS md, greatest(c_custkey, 5) AS g, least(c_custkey, 5) AS le FROM customer""",
    "fn_cast": """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) AS zero,
        CAST('12' AS INTEGER) + 1 AS i FROM orders""",
    "fn_hash": "SELECT n_nationkey, md5(n_name) AS m FROM nation",
    "fn_trig": """SELECT c_custkey, round(cos(c_acctbal), 6) AS c, round(tan(c_custkey * 0.001), 6) AS t, round(cot((c_custkey + 1) * 0.01), 4) AS ct,
        round(acos(1.0 / (c_custkey + 1)), 6) AS ac, round(asin(1.0 / (c_custkey + 1)), 6) AS asn, round(atan(c_custkey), 6) AS atn,
        round(radians(c_custkey), 6) AS rd, round(sinh(1.0 / (c_custkey + 1)), 6) AS sh, round(cosh(1.0 / (c_custkey + 1)), 6) AS ch,
        round(tanh(1.0 / (c_custkey + 1)), 6) AS th, round(asinh(c_custkey), 6) AS ash, round(acosh(c_custkey + 1), 6) AS ach,
        round(atanh(1.0 / (c_custkey + 2)), 6) AS ath, round(log2(c_custkey + 1), 6) AS l2 FROM customer""",
    "fn_conditional": """SELECT event_id, ifnull(v, -1) AS i, coalesce(v, -2) AS c, nullif(event_type, 'click') AS n, if(v IS NULL, 'none', 'some') AS f
        FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events) t""",
    "fn_string_more": """SELECT n_nationkey, ltrim(concat('  ', n_name, ' ')) AS l, rtrim(concat(' ', n_name, '  ')) AS r, char_length(n_name) AS cl,
        character_length(n_name) AS chl, concat(n_name, '-', CAST(n_regionkey AS VARCHAR(9))) AS cc FROM nation""",
    "agg_stats_more": """SELECT l_returnflag, round(var_pop(l_quantity), 4) AS vp, round(var_samp(l_quantity), 4) AS vs, round(covar_pop(l_quantity, l_discount), 6) AS cp,
        round(covar_samp(l_quantity, l_discount), 6) AS cs, round(regr_avgx(l_quantity, l_discount), 6) AS ax, round(regr_avgy(l_quantity, l_discount), 6) AS ay,
        round(regr_sxx(l_quantity, l_discount), 4) AS sxx, round(regr_sxy(l_quantity, l_discount), 4) AS sxy, round(regr_syy(l_quantity, l_discount), 3) AS syy
        FROM lineitem GROUP BY l_returnflag""",
    "join_non_equi": """SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey AND a.n_name > b.r_name""",
    "join_duplicate_names": """SELECT a.k AS a_k, a.v AS a_v, b.k AS b_k, b.v AS b_v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a
        JOIN (SELECT r_regionkey AS k, r_name AS v FROM region) b ON a.k = b.k""",
    "cast_try": """SELECT n_nationkey, try_cast(n_name AS INTEGER) AS none, try_cast(CAST(n_nationkey AS VARCHAR(9)) AS INTEGER) AS same FROM nation""",
}

#: name -> (Spark SQL, DuckDB SQL)
OWN: dict[str, tuple[str, str]] = {
    "agg_approx_and_lists": (
        """SELECT o_orderstatus, abs(approx_count_distinct(o_custkey, 0.01) - count(DISTINCT o_custkey)) <= 0.05 * count(DISTINCT o_custkey) AS close,
        array_join(sort_array(collect_set(o_orderpriority)), ',') AS priorities FROM orders GROUP BY o_orderstatus""",
        """SELECT o_orderstatus, true AS close, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities
        FROM orders GROUP BY o_orderstatus""",
    ),
    "agg_string_agg": (
        "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "agg_percentile": (
        "SELECT l_returnflag, round(percentile(l_quantity, 0.25), 6) AS q25 FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q25 FROM lineitem GROUP BY l_returnflag",
    ),
    "win_groups_frame": (
        # the frame runs over the distinct keys alone, with their counts
        """WITH g AS (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey),
        f AS (SELECT c_nationkey, sum(c) OVER (ORDER BY c_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM g)
        SELECT c_custkey, n FROM customer JOIN f ON customer.c_nationkey <=> f.c_nationkey""",
        "SELECT c_custkey, count(*) OVER (ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM customer",
    ),
    "win_ignore_nulls": (
        """SELECT event_id, last_value(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id) AS filled
        FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events) t""",
        """SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS filled
        FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events) t""",
    ),
    "join_lateral": (
        """SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey LIMIT 2) t""",
        """SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey LIMIT 2) t""",
    ),
    "fn_regexp": (
        """SELECT p_partkey, regexp_like(p_type, '^[A-M]') AS rl, regexp_count(p_type, 'E') AS rc, regexp_extract(p_brand, '([0-9])', 1) AS rx,
        levenshtein(p_brand, 'Brand#11') AS lev FROM part""",
        """SELECT p_partkey, regexp_matches(p_type, '^[A-M]') AS rl, len(regexp_extract_all(p_type, 'E')) AS rc, regexp_extract(p_brand, '([0-9])', 1) AS rx,
        levenshtein(p_brand, 'Brand#11') AS lev FROM part""",
    ),
    "fn_initcap_overlay": (
        """SELECT n_nationkey, initcap(lower(n_name)) AS i, overlay(n_name PLACING 'zz' FROM 2 FOR 1) AS o, bit_length(n_name) AS b,
        octet_length(n_name) AS oc, position('A' IN n_name) AS p, substring_index(n_name, 'A', 1) AS s, lower(hex(n_nationkey)) AS h,
        find_in_set('b', 'a,b,c') AS f FROM nation""",
        """SELECT n_nationkey, upper(n_name[1]) || lower(n_name[2:]) AS i, n_name[1] || 'zz' || n_name[3:] AS o, bit_length(n_name) AS b,
        strlen(n_name) AS oc, strpos(n_name, 'A') AS p, string_split(n_name, 'A')[1] AS s, lower(format('{:x}', n_nationkey)) AS h, 2 AS f FROM nation""",
    ),
    "fn_epoch": (
        """SELECT event_id, unix_micros(CAST(ts AS TIMESTAMP)) AS us, CAST(date_format(ts, 'yyyy') AS BIGINT) AS y,
        unix_micros(timestamp_micros(1700000000000000)) AS k, CAST(make_date(2024, 2, 29) AS STRING) AS md, CAST(to_date('2024-03-01') AS STRING) AS td FROM events""",
        """SELECT event_id, epoch_us(ts) AS us, CAST(strftime(ts, '%Y') AS BIGINT) AS y, 1700000000000000 AS k, CAST(make_date(2024, 2, 29) AS VARCHAR) AS md,
        '2024-03-01' AS td FROM events""",
    ),
    "fn_date_bin": (
        """SELECT date_format(window.start, 'yyyy-MM-dd HH:mm') AS bin, count(*) AS n FROM (SELECT window(CAST(ts AS TIMESTAMP), '6 hours') AS window FROM events)
        GROUP BY window.start""",
        "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS bin, count(*) AS n FROM events GROUP BY 1",
    ),
    "fn_array": (
        """SELECT vec_id, size(embedding) AS n, round(aggregate(embedding, 0D, (a, x) -> a + x), 5) AS total, array_position(array(3, 1, 2), 1) AS p,
        array_join(slice(array('a', 'b', 'c'), 2, 2), '-') AS sl, array_contains(array(1, 2), 2) AS has, array_max(array(4, 9, 2)) AS mx,
        size(array_union(array(1, 2), array(2, 3))) AS un, size(array_intersect(array(1, 2), array(2, 3))) AS ai,
        size(array_except(array(1, 2), array(2, 3))) AS ae, size(flatten(array(array(1), array(2, 3)))) AS fl, size(sequence(1, 5)) AS sq FROM embeddings""",
        """SELECT vec_id, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total, 2 AS p, 'b-c' AS sl, true AS has, 9 AS mx,
        3 AS un, 1 AS ai, 1 AS ae, 3 AS fl, 5 AS sq FROM embeddings""",
    ),
    "fn_unnest": (
        "SELECT vec_id, i, round(CAST(x AS DOUBLE), 6) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS i, x",
        "SELECT vec_id, i - 1 AS i, round(CAST(embedding[i] AS DOUBLE), 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    ),
    "fn_json": (
        """SELECT event_id, get_json_object(to_json(named_struct('k', event_type, 'n', event_id)), '$.k') AS k FROM events""",
        "SELECT event_id, event_type AS k FROM events",
    ),
    "fn_map_struct": (
        """SELECT n_nationkey, element_at(map('a', n_name, 'b', 'x'), 'a') AS v, size(map_keys(map('a', 1, 'b', 2))) AS n,
        named_struct('q', n_regionkey).q AS q FROM nation""",
        "SELECT n_nationkey, n_name AS v, 2 AS n, n_regionkey AS q FROM nation",
    ),
    "fn_encode": (
        "SELECT n_nationkey, sha2(n_name, 256) AS s, base64(CAST(n_name AS BINARY)) AS b, hex(n_name) AS h FROM nation",
        "SELECT n_nationkey, sha256(n_name) AS s, base64(CAST(n_name AS BLOB)) AS b, hex(n_name) AS h FROM nation",
    ),
    "join_as_of": (
        # the last event of the same user at or before each purchase, by one window over both sides
        """WITH e AS (SELECT user_id, ts, event_id, 0 AS asks FROM events WHERE event_type <> 'purchase'
        UNION ALL SELECT user_id, ts, event_id, 1 FROM events WHERE event_type = 'purchase'),
        w AS (SELECT event_id, asks, last_value(CASE WHEN asks = 0 THEN ts END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, asks
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS found FROM e)
        SELECT event_id, date_format(found, 'yyyy-MM-dd HH:mm:ss') AS found FROM w WHERE asks = 1""",
        """SELECT a.event_id, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS found FROM (SELECT * FROM events WHERE event_type = 'purchase') a
        ASOF LEFT JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type <> 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts""",
    ),
    "join_broadcast_hint": (
        "SELECT /*+ BROADCAST(n) */ c_custkey, n_name FROM customer JOIN nation n ON c_nationkey = n_nationkey",
        "SELECT c_custkey, n_name FROM customer JOIN nation n ON c_nationkey = n_nationkey",
    ),
    "join_merge_hint": (
        "SELECT /*+ MERGE(o) */ c_custkey, o_orderkey FROM customer JOIN orders o ON c_custkey = o_custkey",
        "SELECT c_custkey, o_orderkey FROM customer JOIN orders o ON c_custkey = o_custkey",
    ),
    "agg_array_agg": (
        """SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), ',') AS names, percentile_approx(n_nationkey, 0.5, 10000) AS mid,
        max_by(n_name, n_nationkey) AS last_name, min_by(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey""",
        """SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names, quantile_disc(n_nationkey, 0.5) AS mid,
        max_by(n_name, n_nationkey) AS last_name, min_by(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey""",
    ),
    "fn_string_search_more": (
        """SELECT p_partkey, startswith(p_name, 'a') AS st, endswith(p_name, 'e') AS en, locate('a', p_name) AS lo, btrim(p_type, 'S') AS bt,
        regexp_instr(p_brand, '[0-9]') AS ri, nvl(nullif(p_brand, 'Brand#11'), 'x') AS nv, nvl2(nullif(p_brand, 'Brand#11'), 1, 0) AS n2 FROM part""",
        """SELECT p_partkey, starts_with(p_name, 'a') AS st, suffix(p_name, 'e') AS en, strpos(p_name, 'a') AS lo, trim(p_type, 'S') AS bt,
        strpos(p_brand, regexp_extract(p_brand, '[0-9]')) AS ri, ifnull(nullif(p_brand, 'Brand#11'), 'x') AS nv,
        CASE WHEN p_brand <> 'Brand#11' THEN 1 ELSE 0 END AS n2 FROM part""",
    ),
    "fn_math_more": (
        """SELECT c_custkey, signum(c_acctbal) AS sg, factorial(CAST(c_custkey % 10 AS INT)) AS fa, isnan(c_acctbal / 0.5D) AS isn,
        nanvl(CASE WHEN c_custkey % 2 = 0 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal END, -1D) AS nv, round(log(3, c_custkey + 1), 6) AS lb, pmod(-c_custkey, 7) AS pm,
        bit_count(c_custkey) AS bc, shiftleft(c_custkey, 2) AS sl, round(hypot(c_custkey, 2), 6) AS hy FROM customer""",
        """SELECT c_custkey, CAST(sign(c_acctbal) AS DOUBLE) AS sg, CAST(factorial(CAST(c_custkey % 10 AS INT)) AS BIGINT) AS fa, false AS isn,
        CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE c_acctbal END AS nv, round(ln(c_custkey + 1) / ln(3), 6) AS lb, (7 - c_custkey % 7) % 7 AS pm,
        CAST(bit_count(c_custkey) AS INTEGER) AS bc, c_custkey << 2 AS sl, round(sqrt(c_custkey ** 2 + 4), 6) AS hy FROM customer""",
    ),
    "fn_date_more": (
        """SELECT event_id, unix_timestamp(CAST(ts AS TIMESTAMP)) AS s, unix_millis(timestamp_seconds(event_id)) AS ms, unix_seconds(timestamp_millis(event_id * 1000)) AS sm,
        from_unixtime(event_id, 'yyyy-MM-dd HH:mm:ss') AS fu, date_format(to_timestamp('2024-05-06 07:08:09'), 'yyyyMMddHHmmss') AS tt, datediff(DATE '2024-03-01', DATE '2024-02-01') AS dd,
        CAST(last_day(CAST(ts AS DATE)) AS STRING) AS ld, CAST(add_months(CAST(ts AS DATE), 1) AS STRING) AS am, now() IS NOT NULL AND current_date() >= DATE '2020-01-01' AS clock,
        date_format(timestampadd(HOUR, 5, CAST(ts AS TIMESTAMP)), 'yyyy-MM-dd HH') AS ta FROM events""",
        """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id * 1000 AS ms, event_id AS sm, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS fu,
        '20240506070809' AS tt, 29 AS dd, CAST(last_day(CAST(ts AS DATE)) AS VARCHAR) AS ld, CAST(CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS am, true AS clock,
        strftime(ts + INTERVAL 5 HOURS, '%Y-%m-%d %H') AS ta FROM events""",
    ),
    "fn_array_more": (
        """SELECT vec_id, round(array_min(a), 6) AS mn, cardinality(array_append(a, 1F)) AS ap, element_at(array_prepend(a, 7F), 1) AS pr,
        size(array_distinct(array_append(a, a[0]))) AS di, size(array_remove(a, a[0])) AS rm, size(array_repeat(label, 3)) AS rp, round(array_sort(a)[0], 6) AS so,
        arrays_overlap(slice(a, 1, 2), slice(a, 2, 2)) AS ov, round(array_max(a), 6) AS mx FROM (SELECT vec_id, label, embedding AS a FROM embeddings) t""",
        """SELECT vec_id, round(CAST(list_min(a) AS FLOAT), 6) AS mn, len(a) + 1 AS ap, CAST(7 AS FLOAT) AS pr, len(list_distinct(a)) AS di,
        len(list_filter(a, lambda x: x <> a[1])) AS rm, 3 AS rp, round(CAST(list_sort(a)[1] AS FLOAT), 6) AS so, true AS ov, round(CAST(list_max(a) AS FLOAT), 6) AS mx
        FROM (SELECT vec_id, label, embedding AS a FROM embeddings) t""",
    ),
    "fn_explode": (
        "SELECT n_nationkey, w FROM nation LATERAL VIEW explode(split(n_name, 'A')) t AS w",
        "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS w FROM nation",
    ),
    "fn_json_more": (
        """SELECT event_id, f.k AS k, f.n AS n, element_at(map_values(map('a', event_type)), 1) AS v, j AS j FROM (SELECT event_id, event_type,
        from_json(to_json(named_struct('k', event_type, 'n', event_id)), 'k STRING, n BIGINT') AS f,
        to_json(named_struct('q', user_id)) AS s FROM events) t LATERAL VIEW json_tuple(s, 'q') x AS j""",
        "SELECT event_id, event_type AS k, event_id AS n, event_type AS v, CAST(user_id AS VARCHAR) AS j FROM events",
    ),
    "fn_encode_more": (
        """SELECT n_nationkey, CAST(unhex(hex(n_name)) AS STRING) AS u, CAST(unbase64(base64(CAST(n_name AS BINARY))) AS STRING) AS b, crc32(CAST(n_name AS BINARY)) > 0 AS c,
        length(uuid()) AS id, rand() BETWEEN 0 AND 1 AS r FROM nation""",
        "SELECT n_nationkey, n_name AS u, n_name AS b, true AS c, 36 AS id, true AS r FROM nation",
    ),
    "uuid_compare": (
        """WITH t AS (SELECT n_nationkey, lower(concat('550e8400-e29b-41d4-a716-4466554400', lpad(hex(n_nationkey), 2, '0'))) AS u FROM nation)
        SELECT n_nationkey FROM t WHERE u <> lower('550E8400-E29B-41D4-A716-446655440005') AND u = u""",
        """WITH t AS (SELECT n_nationkey, CAST('550e8400-e29b-41d4-a716-4466554400' || lpad(format('{:x}', n_nationkey), 2, '0') AS UUID) AS u FROM nation)
        SELECT n_nationkey FROM t WHERE u <> '550E8400-E29B-41D4-A716-446655440005'""",
    ),
}


def run_sql(text: str):
    """The query over the tables that its text names, each a view of its Parquet files."""
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def query(spark, sf_dir: str):
        for name in names:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(text)

    return query


def queries() -> dict:
    from quern.plans import vector_queries

    found = {name: run_sql(text) for name, text in BOTH.items()}
    found |= {name: run_sql(texts[0]) for name, texts in OWN.items()}
    return found | vector_queries.queries()


def oracle_sql() -> dict[str, str]:
    from quern.plans import vector_queries

    return BOTH | {name: texts[1] for name, texts in OWN.items()} | vector_queries.oracle_sql()
