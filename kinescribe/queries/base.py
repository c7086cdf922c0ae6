"""Registry of queries and shared pieces of their SQL twins.

A query is a function ``(spark, sf_dir) -> DataFrame``; its twin is SQL over the same tables, written with
plain windows so that it is independent of the chunked plans it checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL twin where SQL can express it."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(column: str | Column, digits: int = 6, alias: str | None = None) -> Column:
    """Rounded output column (adding 0.0 turns a negative zero into zero)."""
    name = alias or (column if isinstance(column, str) else None)
    col = F.col(column) if isinstance(column, str) else column
    return (F.round(col.cast("double"), digits) + F.lit(0.0)).alias(name)


def sr(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL twin of :func:`r`."""
    return f"ROUND(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name or expr}"


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- fixtures in SQL ---------------------------------------------------------------------------------

def trace_cte(ts: str = "frame_idx / 30.0") -> str:
    return f"""ev AS (
  SELECT user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS hand,
         event_type, value, CAST(props->>'k' AS DOUBLE) AS k,
         ROW_NUMBER() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS frame_idx
  FROM events),
trace AS (
  SELECT session_id, hand, frame_idx, {ts} AS ts,
         CASE WHEN event_type <> 'error' THEN CAST(TRUNC(value * 1.3) AS DOUBLE) END AS x,
         CASE WHEN event_type <> 'error' THEN CAST(TRUNC(k * 4.8) AS DOUBLE) END AS y,
         CASE WHEN event_type <> 'error' THEN 1.0 + k / 100.0 END AS z
  FROM ev)"""


#: Filtered trace with the informative parameters: jumps of 25 % of the 800-pixel diagonal, 3 points.
FILTERED_CTE = """w1a AS (
  SELECT *, LAG(x) OVER p AS px, LAG(y) OVER p AS py FROM trace
  WINDOW p AS (PARTITION BY session_id, hand ORDER BY frame_idx)),
w1b AS (
  SELECT *, SUM(CASE WHEN x IS NULL OR px IS NULL OR SQRT((x-px)*(x-px)+(y-py)*(y-py)) > 0.25 * 800.0
                THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, hand ORDER BY frame_idx) AS seg FROM w1a),
w1c AS (SELECT *, COUNT(x) OVER (PARTITION BY session_id, hand, seg) AS n FROM w1b),
filtered AS (
  SELECT session_id, hand, frame_idx, ts, CASE WHEN n >= 3 THEN x END AS x,
         CASE WHEN n >= 3 THEN y END AS y, CASE WHEN n >= 3 THEN z END AS z FROM w1c)"""
