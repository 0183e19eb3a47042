"""Queries through the SQL passthrough: the same text runs in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.store import select_only
from weftline.sources.tables import register_views

SQL = {
    "sql_pricing": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_join_five": """SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
    "sql_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_rollup": "SELECT event_type, user_id % 3 AS part, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 3)",
    "sql_full_outer": "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k",
    "sql_set_operations": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey < 10)",
    "sql_window": """SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three,
lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders""",
    "sql_exists": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'P')",
    "sql_scalar_subquery": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT 1.05 * avg(p_retailprice) FROM part)",
    "sql_having": "SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey HAVING count(*) > 30",
    "sql_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 10) SELECT n, f FROM r",
}


def _query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir)
        return select_only(spark, text)

    return run


QUERIES = {name: _query(text) for name, text in SQL.items()}
