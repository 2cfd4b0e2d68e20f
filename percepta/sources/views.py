"""Domain views over the driver tables. The same SQL text runs in Spark and, for the oracle, in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_positions": """
SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_id,
       value AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y
FROM events""",
    "v_detections": """
SELECT stream_id, frame_id, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY obj) - 1 AS det_idx,
       obj, x1, y1, x1 + 40 AS x2, y1 + 60 AS y2, confidence, class_id
FROM (SELECT user_id % 10 AS stream_id, CAST(floor(user_id / 10) AS BIGINT) AS obj, event_id,
             CAST(extract(DAY FROM ts) AS BIGINT) * 4 + CAST(floor(extract(HOUR FROM ts) / 6) AS BIGINT) - 4 AS frame_id,
             CAST(100 * floor(user_id / 10) + event_id % 7 AS DOUBLE) AS x1,
             CAST(50 * (user_id % 10) + event_id % 5 AS DOUBLE) AS y1,
             CAST(5 + 5 * (event_id % 20) AS DOUBLE) / 100 AS confidence, event_id % 3 AS class_id,
             row_number() OVER (PARTITION BY user_id, extract(DAY FROM ts), floor(extract(HOUR FROM ts) / 6) ORDER BY ts, event_id) AS rn
      FROM events) q
WHERE rn = 1""",
    "v_points": """
SELECT l_suppkey AS cloud_id,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey,
                          l_partkey, l_linenumber, l_shipdate, l_returnflag, l_linestatus) - 1 AS pt_idx,
       l_quantity - 25 AS x, l_extendedprice / 2000 - 25 AS y, l_discount * 50 - 1 AS z, l_tax AS intensity
FROM lineitem""",
    "v_sensor": """
SELECT user_id AS vehicle_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       CAST(extract(DAY FROM ts) AS DOUBLE) * 24 + CAST(extract(HOUR FROM ts) AS DOUBLE) + CAST(extract(MINUTE FROM ts) AS DOUBLE) / 60 AS t,
       CASE WHEN event_type = 'purchase' THEN 'gps' ELSE 'imu' END AS kind,
       CAST(event_id % 7 - 3 AS DOUBLE) / 10 AS ax, CAST(event_id % 5 - 2 AS DOUBLE) / 10 AS ay, CAST(0 AS DOUBLE) AS az,
       CAST(event_id % 3 - 1 AS DOUBLE) / 100 AS gz,
       CAST(event_id % 101 - 50 AS DOUBLE) / 10000 AS lat, CAST(event_id % 97 - 48 AS DOUBLE) / 10000 AS lon,
       value / 10 AS alt, CAST(event_id % 4 AS DOUBLE) AS speed,
       CAST(event_id * 37 % 360 AS DOUBLE) AS heading, CAST(1 + event_id % 5 AS DOUBLE) AS accuracy
FROM events""",
    "v_transitions": """
SELECT o_custkey AS episode_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step,
       o_totalprice / 100000 AS obs0, CAST(o_orderkey % 10 AS DOUBLE) AS obs1,
       CAST(o_orderkey % 15 - 7 AS DOUBLE) AS act0, CAST(o_orderkey % 121 - 60 AS DOUBLE) AS act1,
       o_totalprice / 100000 AS reward, CAST(o_orderkey % 41 AS DOUBLE) AS speed,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS done
FROM orders""",
    "v_latency": """
SELECT user_id % 10 AS stream_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS seq, value / 3 AS latency_ms
FROM events""",
    "v_pixels": """
SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS image_id, CAST(floor(p_partkey % 100 / 10) AS BIGINT) AS y, p_partkey % 10 AS x,
       CAST((p_size * 7 + p_partkey * 13) % 256 AS DOUBLE) / 255 AS grey,
       2 + CAST(p_size AS DOUBLE) / 10 AS depth, 1 / (2 + CAST(p_size AS DOUBLE) / 10) AS inv_depth
FROM part""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = re.search(r"FROM (events|lineitem|orders|part)\b", VIEWS[name])[1]
    return spark.sql(re.sub(rf"FROM {table}\b", "FROM {src}", VIEWS[name]), src=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_view(name: str, sql: str) -> str:
    """DuckDB SQL in which the view is the first common table expression."""
    return f"WITH RECURSIVE {name} AS ({VIEWS[name]}){'' if re.match(r"\s*SELECT\b", sql) else ','} {sql}"
