"""Views that give the given tables the shapes of market, energy, match, book and option data.

The same SQL text runs on Spark and on DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "order_flow": """
SELECT obs_id, event_id,
  CAST(row_number() OVER (PARTITION BY obs_id ORDER BY ts, event_id) - 1 AS BIGINT) AS event_idx,
  CAST(event_id % 6 AS INT) AS venue, CAST(event_id % 7 AS BIGINT) AS order_id, event_type AS action,
  CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, event_type = 'purchase' AS trade,
  value AS price, value - CAST(0.01 AS DOUBLE) * (1 + event_id % 5) AS bid, value + CAST(0.01 AS DOUBLE) * (1 + event_id % 3) AS ask,
  CAST(1 + event_id % 50 AS DOUBLE) AS bid_size, CAST(1 + event_id % 37 AS DOUBLE) AS ask_size,
  value * (event_id % 41 - 20) AS flux
FROM (SELECT user_id AS obs_id, event_id, ts, event_type, value FROM events) e""",
    "gaps": """
SELECT obs_id, event_id, event_idx, CASE WHEN event_id % 11 = 0 THEN NULL ELSE price END AS price,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE bid_size END AS bid_size,
  CASE WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 19 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE ask_size END AS ask_size
FROM order_flow""",
    "series_label": "SELECT user_id AS obs_id, CAST(user_id % 24 AS INT) AS eqt_code_cat FROM events GROUP BY user_id",
    "zone_series": "SELECT date_trunc('hour', ts) AS ts, event_type AS zone, value FROM events",
    "raw_times": """
SELECT event_id, event_type AS zone, CASE event_id % 3
    WHEN 0 THEN substring(CAST(ts AS VARCHAR(40)), 1, 19)
    WHEN 1 THEN substring(CAST(ts AS VARCHAR(40)), 9, 2) || '/' || substring(CAST(ts AS VARCHAR(40)), 6, 2) || '/' || substring(CAST(ts AS VARCHAR(40)), 1, 4) || ' ' || substring(CAST(ts AS VARCHAR(40)), 12, 5)
    ELSE 'not a time' END AS StartDatetime,
  '2024-S' || CAST(1 + event_id % 2 AS VARCHAR(1)) AS TIME_PERIOD
FROM events""",
    "book_orders": """
SELECT o_orderkey AS id, o_custkey % 50 AS instrument,
  CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  CAST(90 + (o_orderkey * 7919) % 41 AS DOUBLE) * 0.5 AS price,
  1 + o_orderkey % 80 AS qty, o_orderdate AS ts
FROM orders""",
    "resting": """
SELECT id, instrument, side, CASE WHEN side = 'buy' THEN price - CAST(10.5 AS DOUBLE) ELSE price + CAST(10.5 AS DOUBLE) END AS price, qty, ts
FROM book_orders WHERE id % 5 <> 0""",
    "takers": """
SELECT id, instrument, side, price, qty * 20 AS qty, tif, post_only FROM (
  SELECT id, instrument, side, price, qty, CASE id % 3 WHEN 0 THEN 'GTC' WHEN 1 THEN 'IOC' ELSE 'FOK' END AS tif, id % 4 = 1 AS post_only,
    row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, id DESC) AS n FROM book_orders WHERE id % 5 = 0) t WHERE n = 1""",
    "stops": "SELECT id, instrument, side, price AS stop_price, ts, qty, CASE WHEN id % 2 = 0 THEN 'stop' ELSE 'stop_limit' END AS type FROM book_orders WHERE id % 3 = 0",
    "trades": "SELECT id, instrument, side, price, qty, ts FROM book_orders WHERE id % 3 = 1",
    "contract": """
SELECT p_partkey AS contract_id, p_retailprice AS s, CAST(850 + 4 * p_size AS DOUBLE) AS k,
  CAST(0.1 AS DOUBLE) * (1 + p_partkey % 20) AS t, CAST(0.01 AS DOUBLE) * (1 + p_partkey % 10) AS r,
  CAST(0.1 AS DOUBLE) * (1 + p_partkey % 5) AS sigma,
  CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS option_type
FROM part""",
    "daily_close": "SELECT event_type AS instrument, date_trunc('day', ts) AS day, max_by(value, event_id) AS close FROM events GROUP BY 1, 2",
    "home_stats": "SELECT l_orderkey AS id, sum(l_quantity) AS shots, round(avg(l_extendedprice), 6) AS poss FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey",
    "away_stats": "SELECT l_orderkey AS id, sum(l_quantity) AS shots, round(avg(l_extendedprice), 6) AS poss FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey",
    "match_score": "SELECT h.id, h.shots - a.shots AS diff, CASE WHEN h.shots > a.shots THEN 1 ELSE 0 END AS home_wins, CASE WHEN h.shots = a.shots THEN 1 ELSE 0 END AS draw, CASE WHEN h.shots < a.shots THEN 1 ELSE 0 END AS away_wins FROM home_stats h JOIN away_stats a ON h.id = a.id",
    "pred": "SELECT vec_id AS id, label AS y, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS p FROM embeddings",
    "scores": """
SELECT vec_id AS id, CAST(vec_id % 24 AS INT) AS y, embedding FROM embeddings""",
    "shocks": """
SELECT sim_id,
  CAST(row_number() OVER (PARTITION BY sim_id
       ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INT) AS step,
  (l_quantity - CAST(25.5 AS DOUBLE)) / CAST(14.43 AS DOUBLE) AS z
FROM (SELECT l_suppkey AS sim_id, * FROM lineitem) x""",
    "pixels": "SELECT DISTINCT l_orderkey AS picture, l_linenumber AS label FROM lineitem",
    "annotated": "SELECT DISTINCT l_orderkey AS picture, l_linenumber AS label FROM lineitem WHERE l_returnflag <> 'N'",
}


def _needs(text: str) -> list[str]:
    """Views and tables that a text reads, in the order of definition."""
    words = set(re.findall(r"\b\w+\b", text))
    return [n for n in (*TABLES, *VIEWS) if n in words]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or table) over the tables of a folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in _needs(text) if n != name and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)}
    for n in inputs:
        text = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", text)
    return spark.sql(text, **inputs)


def with_views(body: str) -> str:
    """DuckDB SQL with the views that it reads in front."""
    needed: list[str] = []

    def add(text: str) -> None:
        for n in VIEWS:
            if n not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text):
                add(VIEWS[n])
                if n not in needed:
                    needed.append(n)

    add(body)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if not head:
        return body
    lead = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    return f"WITH {lead[1] or ''}{head},\n{body[lead.end():]}" if lead else f"WITH {head}\n{body}"
