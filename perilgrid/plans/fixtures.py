"""Inputs for the registered queries: SQL views over the driver's tables, one text for both engines.

The tables carry no coordinates, so places, zones, detections, cases and status events are derived from their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS = """
SELECT event_id, event_type, user_id, CAST(CAST(ts AS DATE) AS STRING) AS d,
  CASE WHEN event_type = 'error' THEN 37.34e0 + (event_id * 7919 % 1200) / 10000e0
       ELSE 37.35e0 + (user_id % 10) * 0.01e0 + (value - 250e0) / 1000000e0 END AS lat,
  CASE WHEN event_type = 'error' THEN 126.87e0 + (event_id * 104729 % 1300) / 10000e0
       ELSE 126.88e0 + (CAST(floor(user_id / 10e0) AS INT) % 11) * 0.01e0 + ((event_id * 37) % 1000 - 500) / 1000000e0 END AS lon
FROM events"""

DAMAGE = f"""
SELECT event_id AS _row_id,
  CASE WHEN event_id % 50 = 7 THEN NULL WHEN event_id % 20 = 0 AND event_id > 0 THEN CAST(event_id - 1 AS STRING) ELSE CAST(event_id AS STRING) END AS category_no,
  CASE WHEN event_id % 3 = 0 THEN concat('  ', event_type, ' ') ELSE event_type END AS hazard_type,
  CASE WHEN event_id % 101 = 0 THEN 'unknown' WHEN event_id % 4 = 0 THEN replace(d, '-', '') WHEN event_id % 4 = 1 THEN replace(d, '-', '.') WHEN event_id % 4 = 2 THEN replace(d, '-', '/') ELSE d END AS collected_at,
  CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 97 = 1 THEN 'none given' WHEN event_id % 97 = 2 THEN '35.1' WHEN event_id % 97 = 3 THEN NULL WHEN event_id % 97 = 4 THEN concat('"', CAST(lat AS STRING), '"') WHEN event_id % 97 = 5 THEN '1,234' ELSE CAST(lat AS STRING) END AS lat,
  CASE WHEN event_id % 89 = 0 THEN ' ' WHEN event_id % 89 = 1 THEN 'x' WHEN event_id % 89 = 2 THEN '129.0' ELSE CAST(lon AS STRING) END AS lon,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('L', CAST(user_id % 25 AS STRING)) END AS node_link,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('road ', CAST(user_id % 12 AS STRING)) END AS road_address,
  '2024-01-31' AS base_date,
  CASE WHEN event_id % 5 = 0 THEN 'B' ELSE 'A' END AS source
FROM ({POINTS}) g"""

ZONES = """
SELECT s_suppkey AS _row_id, s_name AS zone_name,
  CAST(CASE WHEN s_suppkey % 10 = 9 THEN 37.34e0 + (s_suppkey - 1) % 100 * 0.0012e0 ELSE 37.34e0 + s_suppkey % 100 * 0.0012e0 END AS STRING) AS lat,
  CAST(CASE WHEN s_suppkey % 10 = 9 THEN 126.87e0 + ((s_suppkey - 1) * 37) % 100 * 0.0013e0 ELSE 126.87e0 + (s_suppkey * 37) % 100 * 0.0013e0 END AS STRING) AS lon,
  concat('addr ', n_name) AS address, r_name AS sido, n_name AS sigungu, 'school' AS facility_kind
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

DETECTIONS = """
SELECT l_orderkey AS image_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS det_id,
  CASE WHEN l_returnflag = 'R' THEN 'D40' WHEN l_returnflag = 'A' THEN 'D20' WHEN l_linestatus = 'O' THEN 'D10' ELSE 'Dxx' END AS class_name,
  l_discount * 9e0 + l_tax AS confidence,
  (l_partkey % 8) * 4e0 AS x1, (l_suppkey % 8) * 4e0 AS y1,
  (l_partkey % 8) * 4e0 + 8e0 + l_quantity / 2e0 AS x2, (l_suppkey % 8) * 4e0 + 8e0 + l_quantity / 2e0 AS y2
FROM lineitem"""

CASES = """
SELECT o_orderkey AS id, o_orderdate AS created_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN '접수' WHEN '2-HIGH' THEN '점검예정' WHEN '3-MEDIUM' THEN '현장확인' WHEN '4-NOT SPECIFIED' THEN '보수필요' ELSE '처리완료' END AS status,
  o_totalprice / 10000e0 AS ai_risk_score, o_orderstatus = 'F' AS ai_available FROM orders"""

EVENTS = """
SELECT event_id AS id, user_id AS inspection_id, ts AS changed_at,
  CASE event_type WHEN 'signup' THEN '접수' WHEN 'view' THEN '점검예정' WHEN 'click' THEN '현장확인' WHEN 'error' THEN '보수필요' ELSE '처리완료' END AS to_status FROM events"""

#: Component scores with every pattern of nulls.
SCORES = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 4000e0 END AS history_density,
  CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 101 * 1e0 END AS photo_severity,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 140 - 20e0 END AS school_zone,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 100 * 1e0 END AS road_importance,
  CASE WHEN o_orderkey % 11 <> 0 THEN 100e0 - o_custkey % 90 END AS rainfall
FROM orders"""

#: Every customer is a stop; twelve neighbouring keys are a route, or two.
_STOPS = """
SELECT CAST(floor(c_custkey / {size}e0) AS BIGINT) AS route_id,
  CAST(row_number() OVER (PARTITION BY CAST(floor(c_custkey / {size}e0) AS BIGINT) ORDER BY c_custkey) - 1 AS INT) AS pos,
  37.34e0 + c_custkey * 7919 % 1200 / 10000e0 AS lat, 126.87e0 + c_custkey * 104729 % 1300 / 10000e0 AS lon
FROM customer"""
STOPS, SHORT_STOPS, SOME_STOPS = (_STOPS.format(size=n) for n in (12, 2, 8))

RAIN_ITEMS = """
SELECT o_custkey AS request_id, o_orderkey AS pos, CAST(CAST(o_orderdate AS DATE) AS STRING) AS fcstDate, CASE WHEN o_orderkey % 2 = 0 THEN '0600' ELSE '0900' END AS fcstTime,
  CASE o_orderkey % 3 WHEN 0 THEN 'PCP' WHEN 1 THEN 'POP' ELSE 'TMP' END AS category,
  CASE WHEN o_orderkey % 12 = 0 THEN '강수없음' WHEN o_orderkey % 12 = 3 THEN '1.0mm 미만' WHEN o_orderkey % 12 = 6 THEN concat(CAST(o_orderkey % 50 AS STRING), '.5mm') WHEN o_orderkey % 12 = 9 THEN '50.0mm 이상' WHEN o_orderkey % 12 = 4 THEN 'n/a' ELSE CAST(o_orderkey % 100 AS STRING) END AS fcstValue
FROM orders"""

#: The same items as answers for grid points and slots; the answers for one point hold an error instead.
FORECASTS = f"""
SELECT '20240501' AS base_date, CASE WHEN pos % 2 = 0 THEN '0200' ELSE '0500' END AS base_time, CAST(55 + request_id % 5 AS INT) AS nx,
  CAST(120 + CAST(floor(request_id / 5e0) AS INT) % 4 AS INT) AS ny, pos, fcstDate, fcstTime, category, fcstValue FROM ({RAIN_ITEMS}) i"""

#: Degrees, minutes and seconds, some out of range.
DMS = """
SELECT event_id AS id, event_id % 95 * 1e0 AS d, event_id % 60 * 1e0 AS m, event_id * 7 % 600 / 10e0 AS s, event_type = 'error' AS negative FROM events"""

#: The service's answers: with items, with a header only, and with neither.
ANSWERS = """
SELECT o_orderkey AS request_id, CASE o_orderkey % 4
  WHEN 0 THEN '{"response":{"header":{"resultCode":"00","resultMsg":"OK"},"body":{"items":{"item":[{"category":"POP"}]}}}}'
  WHEN 1 THEN concat('{"response":{"header":{"resultCode":"', CAST(o_orderkey % 33 AS STRING), '","resultMsg":"NO DATA"}}}')
  WHEN 2 THEN '{"response":{}}' ELSE '{}' END AS payload FROM orders"""

#: A detector's candidates: a box and a score for each of four classes.
CANDIDATES = """
SELECT CAST(floor(l_orderkey / 64e0) AS BIGINT) AS image_id,
  row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 64e0) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS det_id,
  CAST(l_partkey % 4 AS INT) AS class_id, CASE l_partkey % 4 WHEN 0 THEN 'D00' WHEN 1 THEN 'D10' WHEN 2 THEN 'D20' ELSE 'D40' END AS class_name,
  (1 + l_suppkey % 15) / 16e0 AS confidence, 20e0 + l_partkey % 600 AS cx, 160e0 + l_suppkey % 320 AS cy, l_quantity AS w, l_quantity + 1e0 AS h
FROM lineitem"""

#: Large images with about a thousand boxes each, in heaps.
CROWDED = """
SELECT CAST(floor(l_orderkey / 256e0) AS BIGINT) AS image_id,
  row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 256e0) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS det_id,
  'D00' AS class_name, l_discount * 9e0 + l_tax AS confidence,
  l_partkey % 16 * 230e0 + l_orderkey % 24 AS x1, l_suppkey % 8 * 260e0 + l_partkey % 20 AS y1,
  l_partkey % 16 * 230e0 + l_orderkey % 24 + 30e0 + l_quantity * 2e0 AS x2, l_suppkey % 8 * 260e0 + l_partkey % 20 + 40e0 + l_quantity AS y2
FROM lineitem"""

#: Rows for CSV files: Korean texts, and texts of several lines.
KOREAN = f"""
SELECT event_id AS category_no, concat('포트홀 ', event_type) AS hazard_type, CAST(lat AS STRING) AS lat, CAST(lon AS STRING) AS lon,
  concat('안양로 ', CAST(user_id AS STRING), ', 만안구') AS road_address, d AS base_date, concat('길', CAST(user_id % 25 AS STRING)) AS node_link FROM ({POINTS}) g"""
NOTES = f"""
SELECT CAST(event_id AS STRING) AS category_no, event_type AS hazard_type, CAST(lat AS STRING) AS lat, CAST(lon AS STRING) AS lon,
  CASE event_id % 3 WHEN 0 THEN concat('road', chr(10), event_type, ', "', CAST(user_id AS STRING), '"', chr(10), chr(10)) WHEN 1 THEN concat('"', chr(10), '",') ELSE 'road' END AS road_address FROM ({POINTS}) g"""

#: Places over the whole globe, some at both sides of the antimeridian, some around the north pole.
_GLOBE = """
SELECT {key} AS {name},
  CASE {key} % 3 WHEN 0 THEN 10e0 + {key} % 100 / 10000e0 WHEN 1 THEN 89.99e0 + {key} % 100 / 10000e0 ELSE {key} * 7919 % 18001 / 100e0 - 90e0 END AS lat,
  CASE {key} % 3 WHEN 0 THEN CASE WHEN {key} % 2 = 0 THEN 179.999e0 + {key} % 9 / 10000e0 ELSE {key} % 9 / 10000e0 - 179.9999e0 END ELSE {key} * 104729 % 36001 / 100e0 - 180e0 END AS lon
FROM {table}"""
GLOBE_POINTS, GLOBE_TARGETS = _GLOBE.format(key="event_id", name="_row_id", table="events"), _GLOBE.format(key="s_suppkey", name="target_id", table="supplier")

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view's rows over the tables of a folder."""
    for name in TABLES:
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)
