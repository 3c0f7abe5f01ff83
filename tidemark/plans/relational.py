"""Relational queries: one text for Spark and for DuckDB, tables in braces.

Spark gets versioned tables' scans as DataFrames (no global views).  The tables adopt
the input's files where they lie, so Catalyst sees plain Parquet scans and prunes,
pushes down and reorders as it likes.
"""

from __future__ import annotations

from string import Formatter

from tidemark.sources.scratch import scratch
from tidemark.sources.store import Store
from tidemark.sources.table import Table

_adopted: dict[tuple, Table] = {}

REVENUE = "l_extendedprice * (1 - l_discount)"

TEXTS = {
    "tpch_q3": f"""
SELECT l_orderkey, CAST(sum(CAST({REVENUE} AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, o_orderdate
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q5": f"""
SELECT n_name, CAST(sum(CAST({REVENUE} AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
JOIN {{supplier}} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name""",
    "tpch_q6": """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q7": f"""
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, CAST(sum(CAST({REVENUE} AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM {{supplier}} JOIN {{lineitem}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{customer}} ON c_custkey = o_custkey
JOIN {{nation}} n1 ON s_nationkey = n1.n_nationkey JOIN {{nation}} n2 ON c_nationkey = n2.n_nationkey
WHERE n1.n_regionkey <> n2.n_regionkey AND n1.n_nationkey < 6 AND n2.n_nationkey < 12 GROUP BY n1.n_name, n2.n_name, year(l_shipdate)""",
    "tpch_q8": f"""
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share, count(*) AS n
FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
  FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{orders}} ON l_orderkey = o_orderkey
  JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} n1 ON c_nationkey = n1.n_nationkey JOIN {{region}} ON n1.n_regionkey = r_regionkey
  JOIN {{nation}} n2 ON s_nationkey = n2.n_nationkey WHERE r_regionkey = 1) all_nations GROUP BY o_year""",
    "tpch_q10": f"""
SELECT c_custkey, c_name, CAST(sum(CAST({REVENUE} AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, c_acctbal, n_name
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{nation}} ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1995-10-01' AND o_orderdate < DATE '1996-01-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q14": f"""
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1995-10-01'""",
    "tpch_q15": f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, CAST(sum(CAST({REVENUE} AS DECIMAL(18, 4))) AS DOUBLE) AS total_revenue FROM {{lineitem}}
  WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {{supplier}} JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "tpch_q18": """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS quantity
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "r1_star_join": """
SELECT r_name, p_brand, count(*) AS n FROM {lineitem}, {part}, {supplier}, {nation}, {region}
WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND p_size < 10 GROUP BY r_name, p_brand""",
    "r2_left_join_histogram": """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1%' GROUP BY c_custkey) t GROUP BY c_count""",
    "r3_full_outer_join": """
SELECT coalesce(a.k, b.k) AS k, a.n AS n_orders, b.n AS n_items FROM (SELECT o_custkey % 1000 AS k, count(*) AS n FROM {orders} WHERE o_totalprice > 100000 GROUP BY 1) a
FULL OUTER JOIN (SELECT l_suppkey AS k, count(*) AS n FROM {lineitem} WHERE l_quantity > 49 GROUP BY 1) b ON a.k = b.k""",
    "r4_semi_exists": """
SELECT o_orderpriority, count(*) AS order_count FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o.o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority""",
    "r4_semi_in": "SELECT c_mktsegment, count(*) AS n FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000) GROUP BY c_mktsegment",
    "r5_anti_not_exists": "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c.c_custkey AND o_totalprice > 200000) AND c_acctbal > 0 GROUP BY c_nationkey",
    "r5_anti_not_in": "SELECT p_brand, count(*) AS n FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 48 AND l_discount > 0.04) GROUP BY p_brand",
    "r6_exists_or_exists": """
SELECT c_mktsegment, count(*) AS n FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c.c_custkey AND o_orderstatus = 'P')
OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c.c_custkey AND o_totalprice > 300000) GROUP BY c_mktsegment""",
    "r7_correlated_average": """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem} l JOIN {part} ON p_partkey = l_partkey
WHERE p_size < 20 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM {lineitem} WHERE l_partkey = p_partkey)""",
    "r7_scalar_subquery": "SELECT s_suppkey, s_acctbal FROM {supplier} WHERE s_acctbal > (SELECT avg(s_acctbal) FROM {supplier})",
    "r8_cte": "WITH a AS (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id), b AS (SELECT n, count(*) AS users FROM a GROUP BY n) SELECT n, users FROM b",
    "r9_aggregates": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM {events} GROUP BY event_type",
    "r10_count_distinct": "SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY p_brand",
    "r11_stddev": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_samp(l_extendedprice), 4) AS sd_price FROM {lineitem} GROUP BY l_returnflag",
    "r12_rollup": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM {lineitem} GROUP BY ROLLUP(l_returnflag, l_linestatus)",
    "r13_grouping": """
SELECT CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping(l_linestatus) AS BIGINT) AS g2, l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP(l_returnflag, l_linestatus)""",
    "r14_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE(o_orderstatus, o_orderpriority)",
    "r14_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "r15_having": "SELECT l_partkey, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_partkey HAVING sum(l_quantity) > (SELECT 1.2 * avg(t.q) FROM (SELECT sum(l_quantity) AS q FROM {lineitem} GROUP BY l_partkey) t)",
    "r16_conditional": """
SELECT l_linestatus, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN l_discount <= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM (SELECT l_linestatus, l_discount FROM {lineitem}) t GROUP BY l_linestatus""",
    "r17_rank": "SELECT * FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rnk FROM {orders}) t WHERE rnk <= 2",
    "r18_ratio_to_group": "SELECT p_brand, p_type, round(sum(p_retailprice) * 100 / sum(sum(p_retailprice)) OVER (PARTITION BY p_brand), 6) AS ratio FROM {part} GROUP BY p_brand, p_type",
    "r19_running_frame": "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running FROM {events}",
    "r20_window_functions": """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr,
lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quart FROM {events}""",
    "r21_top_k": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50",
    "r22_union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) t GROUP BY k",
    "r23_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "r24_intersect": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'",
    "r25_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT'",
    "r26_dates": """
SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM {orders}
WHERE o_orderdate >= DATE '1996-06-30' - INTERVAL 1 YEAR AND o_orderdate < DATE '1996-06-30' + INTERVAL 90 DAY GROUP BY year(o_orderdate), month(o_orderdate)""",
    "r27_strings": "SELECT upper(substring(p_name, 1, 3)) AS head, concat(p_brand, '-', p_type) AS label, CAST(length(p_name) AS BIGINT) AS len FROM {part} WHERE p_type LIKE '%E%'",
    "r28_math": "SELECT l_orderkey, l_linenumber, round(abs(l_extendedprice - 50000), 2) AS gap, CAST(floor(l_quantity / 7) AS BIGINT) AS f FROM {lineitem} WHERE abs(l_discount - 0.05) < 0.011",
    "r29_nulls": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, nullif(c_nationkey, 3) IS NULL AS gone FROM {customer}",
    "r30_between_in": "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 50000 AND 60000 AND o_orderpriority IN ('1-URGENT', '5-LOW', '2-HIGH')",
    "r31_distinct": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}",
}


def tables_of(text: str) -> list[str]:
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(text) if name))


def table(spark, sf_dir: str, name: str) -> Table:
    """The versioned table over an input; made once for as long as its files stay as they are."""
    source = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, source, *sorted(Store(spark, source).stamps("").items()))
    if key not in _adopted:
        _adopted[key] = Table.adopt(spark, scratch(spark, name), source)
    return _adopted[key]


def query(text: str):
    def run(spark, sf_dir: str):
        return spark.sql(text, **{t: table(spark, sf_dir, t).read() for t in tables_of(text)})

    return run


QUERIES = {name: query(text) for name, text in TEXTS.items()}
SQL = {name: text.format(**{t: t for t in tables_of(text)}) for name, text in TEXTS.items()}
