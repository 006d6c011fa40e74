"""Registration of the checked queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` gives the same result on the same tables."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


# Shared SQL parts, used with WITH.
CASES = """cases AS (
  SELECT o_orderkey AS report_id, o_custkey AS hn, o_orderdate AS issued, o_orderpriority AS sample,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS panel, CAST(year(o_orderdate) AS INTEGER) AS batch_id
  FROM orders)"""
REPORTS = CASES + """, reports AS (
  SELECT cases.*, c_mktsegment AS species, n_name AS genus
  FROM cases JOIN customer ON c_custkey = hn JOIN nation ON n_nationkey = c_nationkey)"""
LINKS = """ends AS (SELECT min(batch_id) AS first, max(batch_id) AS last FROM cases), links AS (
  SELECT CAST(unnest(generate_series(batch_id - first + 1, last - first + 1)) AS INTEGER) AS version, batch_id
  FROM (SELECT DISTINCT batch_id FROM cases), ends)"""
LINES = """items AS (
  SELECT l_orderkey AS report_id, p_type AS label, l_returnflag, l_linestatus, l_quantity
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""
SYMBOLS = """symbols AS (
  SELECT report_id, label, max(l_returnflag) AS symbol FROM items GROUP BY ALL)"""
ANSWERS = """answers AS (
  SELECT DISTINCT report_id, label FROM items WHERE l_linestatus = 'O')"""
METRICS = """counts AS (
  SELECT label, CAST(year(o_orderdate) - first + 1 AS INTEGER) AS version,
         count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') AS tp,
         count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag = 'R') AS fp,
         count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag <> 'R') AS fn,
         count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag <> 'R') AS tn
  FROM items JOIN orders ON o_orderkey = report_id, (SELECT min(year(o_orderdate)) AS first FROM orders)
  GROUP BY label, year(o_orderdate), first),
metrics AS (
  SELECT *, (tp + tn)::double / (tp + fp + fn + tn) AS accuracy,
         CASE WHEN tp + fp = 0 THEN 0.0::double ELSE tp::double / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0::double ELSE tp::double / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::double ELSE (2 * tp)::double / (2 * tp + fp + fn) END AS f1
  FROM counts)"""
