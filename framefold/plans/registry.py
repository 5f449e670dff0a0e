"""Where queries are registered, and the views of the tables that their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FRAMES = """
    frames AS (
        SELECT user_id AS stream_id, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, epoch_us(ts) / 1e6 AS ts,
            CASE WHEN event_type IN ('click', 'view') THEN 'in_game' WHEN event_type = 'purchase' THEN 'paused'
                WHEN event_type = 'signup' THEN 'level_select' ELSE 'unknown' END AS state,
            CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS conf,
            CAST(floor(coalesce(value, 0)) AS BIGINT) AS raw_score,
            CAST(sum(floor(coalesce(value, 0))) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS score,
            CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lines,
            CASE WHEN event_id % 11 <> 0 THEN (['T', 'J', 'Z', 'O', 'S', 'L', 'I'])[CAST(event_id % 7 + 1 AS INTEGER)] END AS piece
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    )"""
GAMES = """
    games AS (
        SELECT o_orderkey AS game_id, round(o_totalprice, 2) AS score, CAST(o_orderdate AS DATE) AS day, c_name AS player, n_name AS station, o_orderstatus AS status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    )"""
CLEARS = """
    clears AS (
        SELECT l_orderkey AS game_id, CAST((l_linenumber - 1) % 4 + 1 AS BIGINT) AS size, l_partkey % 20 AS level, l_quantity AS quantity, l_extendedprice AS price FROM lineitem
    )"""


def query(name: str, sql: str | None, *views: str) -> Callable:
    """Register a query under a name, with its SQL over the named views."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            if views:
                head = "WITH " + ", ".join(v.strip() for v in views)
                text = f"{head}, {text[5:]}" if text.startswith("WITH ") else f"{head} {text}"
            ORACLE_SQL[name] = text
        return f

    return add
