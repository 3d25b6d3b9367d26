"""SQL that goes to Spark unchanged: one text for both engines, over the tables as views.

These show that all of Spark SQL is within reach of an index query; they are no operators of this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "sql_filter_project": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03 AND l_returnflag = 'R'",
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, CAST(round(sum(l_extendedprice) * 100) AS BIGINT) AS cents_base, CAST(floor(sum(l_extendedprice * (1 - l_discount)) / 1000) AS BIGINT) AS thousands_disc,
      round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_inner_join": "SELECT n_name, count(*) AS n, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS cents FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_right_join": "SELECT n_nationkey, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey",
    "sql_full_join": "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) b ON a.k = b.k",
    "sql_semi_join": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    "sql_anti_join": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)",
    "sql_range_join": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON b.n_nationkey > a.n_nationkey AND b.n_nationkey <= a.n_nationkey + 3",
    "sql_cross_join": "SELECT r_name, l_returnflag FROM region CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem) f",
    "sql_distinct_aggregate": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "sql_rank": "SELECT c_custkey, c_nationkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS d FROM customer",
    "sql_lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "sql_running_sum": "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM lineitem",
    "sql_ntile": "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS q FROM supplier",
    "sql_top_k_per_group": "SELECT n, p_partkey, p_brand FROM (SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS n FROM part) t WHERE n <= 3",
    "sql_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sql_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "sql_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT p_partkey AS k FROM part WHERE p_size < 20",
    "sql_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48",
    "sql_cte": "WITH per AS (SELECT o_custkey AS c, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT max(t) AS m FROM per) SELECT c, CAST(round(t * 100) AS BIGINT) AS cents FROM per, top WHERE t > m / 2",
    "sql_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "sql_case": "SELECT CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY 1",
    "sql_strings": "SELECT p_partkey, upper(p_brand) AS u, substring(p_name, 1, 5) AS s, CAST(length(p_type) AS BIGINT) AS n, concat(p_brand, '-', p_type) AS c, replace(p_name, ' ', '_') AS r FROM part",
    "sql_dates": "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    "sql_math": "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS q, abs(l_discount - 0.05) < 0.02 AS near, CAST(floor(l_extendedprice) AS BIGINT) AS f FROM lineitem",
    "sql_as_of": """SELECT event_id, before_id FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_id FROM events) t WHERE event_type <> 'click'""",
    "sql_approximate": "SELECT l_returnflag, abs(approx_count_distinct(l_suppkey) - count(DISTINCT l_suppkey)) <= 0.25 * count(DISTINCT l_suppkey) AS near FROM lineitem GROUP BY l_returnflag",
    "sql_benchmark_join": "SELECT b.item_id, d.lang, length(b.text) AS n FROM benchmark b JOIN documents d ON d.doc_id = b.item_id",
}


def run(sql: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in sql:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(sql)

    return query
