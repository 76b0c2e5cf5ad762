"""Snapshot tables derived from the given tables, written once for Spark and DuckDB.

``@name`` stands for a given table, ``//`` for whole-number division; both engines get the same
text otherwise. Every fixture covers its whole source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    # Hourly counters per user as radios: weekly (tx) and monthly (rx) resets, text in place of
    # a number, fractions, NULL band, untagged node, gaps.
    "radio_stats": """
WITH h AS (
  SELECT date_trunc('hour', ts) AS fetched_at, user_id,
         SUM(CAST(ROUND(value * 100) AS BIGINT)) AS inc, MIN(event_id) AS eid
  FROM @events GROUP BY date_trunc('hour', ts), user_id),
k AS (
  SELECT fetched_at, user_id, eid,
    CAST(SUM(inc * 100000) OVER (PARTITION BY user_id, date_trunc('week', fetched_at) ORDER BY fetched_at) AS BIGINT) AS tx_b,
    CAST(SUM(inc % 977 * 100000) OVER (PARTITION BY user_id, date_trunc('month', fetched_at) ORDER BY fetched_at) AS BIGINT) AS rx_b,
    CAST(SUM(inc) OVER (PARTITION BY user_id, date_trunc('week', fetched_at) ORDER BY fetched_at) AS BIGINT) AS tx_p,
    CAST(SUM(inc % 7) OVER (PARTITION BY user_id, date_trunc('week', fetched_at) ORDER BY fetched_at) AS BIGINT) AS tx_f
  FROM h)
SELECT 'r' || CAST(eid AS VARCHAR(20)) AS id,
  's' || CAST(fetched_at AS VARCHAR(30)) AS snapshot_id, fetched_at,
  'wifi' || CAST(user_id AS VARCHAR(20)) AS radio,
  CASE user_id % 4 WHEN 0 THEN '2.4G' WHEN 1 THEN '5G low' WHEN 2 THEN '5G high' ELSE NULL END AS band,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE '5E:70:2B:00:00:0' || CAST(user_id % 5 AS VARCHAR(1)) END AS source_node_mac,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'node-' || CAST(user_id % 5 AS VARCHAR(1)) END AS source_node_name,
  '{"tx_data_bytes": ' || CASE WHEN eid % 53 = 0 THEN '"<DISABLED>"' ELSE CAST(tx_b AS VARCHAR(30)) END
    || ', "rx_data_bytes": ' || CAST(rx_b AS VARCHAR(30)) || CASE WHEN eid % 17 = 0 THEN '.75' ELSE '' END
    || ', "tx_data_packets": ' || CAST(tx_p AS VARCHAR(30))
    || ', "tx_failures": ' || CAST(tx_f AS VARCHAR(30))
    || ', "rx_rssi": ' || CAST(20 + eid % 40 AS VARCHAR(10))
    || ', "self_bss_chan_util": ' || CAST(eid % 256 AS VARCHAR(10))
    || ', "obss_chan_util": ' || CASE WHEN eid % 11 = 0 THEN '"<DISABLED>"' ELSE CAST(eid % 200 AS VARCHAR(10)) END
    || ', "lithium_cycle_cnt_chan_nf_bdf_averaged_nf_dbm": ' || CAST(-90 - eid % 10 AS VARCHAR(10)) || '}' AS stats
FROM k""",
    # Hourly counters per interface, resets on different days for rx and tx, NULL interface.
    "nic_counter": """
WITH h AS (
  SELECT date_trunc('hour', ts) AS fetched_at,
         CASE user_id % 5 WHEN 0 THEN 'br0' WHEN 1 THEN 'eth0' WHEN 2 THEN 'eth1' WHEN 3 THEN 'eth2' ELSE NULL END AS intf,
         SUM(CAST(ROUND(value * 100) AS BIGINT)) AS inc, MIN(event_id) AS eid
  FROM @events GROUP BY 1, 2)
SELECT 'n' || CAST(eid AS VARCHAR(20)) AS id, 's' || CAST(fetched_at AS VARCHAR(30)) AS snapshot_id, fetched_at, intf,
  CAST(SUM(inc * 1000) OVER (PARTITION BY intf, date_trunc('week', fetched_at) ORDER BY fetched_at) AS BIGINT) AS rx_bytes,
  CAST(SUM(inc % 997 * 1000) OVER (PARTITION BY intf, date_trunc('month', fetched_at) ORDER BY fetched_at) AS BIGINT) AS tx_bytes
FROM h""",
    # One reading per event: times repeat within an entity, so predecessors come in groups.
    "nic_copies": """
SELECT 'c' || CAST(event_id AS VARCHAR(20)) AS id, 's' || CAST(date_trunc('hour', ts) AS VARCHAR(30)) AS snapshot_id,
  date_trunc('hour', ts) AS fetched_at, 'eth' || CAST(user_id % 3 AS VARCHAR(2)) AS intf,
  CAST(event_id * 1000 AS BIGINT) AS rx_bytes, CAST(ROUND(value * 100) AS BIGINT) AS tx_bytes
FROM @events""",
    # Daily neighbour tables: both families, unknown and NULL interface, unresolved hosts.
    "ip_neighbor": """
SELECT 'i' || CAST(event_id AS VARCHAR(20)) AS id, 's' || CAST(date_trunc('day', ts) AS VARCHAR(30)) AS snapshot_id,
  date_trunc('day', ts) AS fetched_at,
  CASE WHEN event_id % 5 < 3 THEN '10.77.' || CAST(user_id // 250 AS VARCHAR(5)) || '.' || CAST(user_id % 250 AS VARCHAR(5)) ELSE 'fe80::' || CAST(user_id AS VARCHAR(10)) END AS ip,
  CASE WHEN event_id % 5 < 3 THEN 'inet' ELSE 'inet6' END AS family,
  CASE event_id % 7 WHEN 0 THEN 'br0' WHEN 1 THEN 'br1' WHEN 2 THEN 'br2' WHEN 3 THEN 'eth0' WHEN 4 THEN 'eth1' WHEN 5 THEN 'eth9' ELSE NULL END AS iface,
  CASE WHEN event_type = 'error' THEN NULL ELSE '5e:70:2b:00:' || lpad(CAST(user_id // 100 AS VARCHAR(4)), 2, '0') || ':' || lpad(CAST(user_id % 100 AS VARCHAR(4)), 2, '0') END AS mac,
  'Vendor ' || CAST(user_id % 9 AS VARCHAR(4)) AS mac_vendor, user_id % 10 = 0 AS is_router,
  CASE event_type WHEN 'click' THEN 'REACHABLE' WHEN 'view' THEN 'STALE' WHEN 'purchase' THEN 'DELAY' WHEN 'signup' THEN 'PROBE' ELSE 'FAILED' END AS state
FROM @events""",
    # Monthly device tables: blank and NULL names, NULL vendor, upper-case addresses.
    "device": """
SELECT 'd' || CAST(o_orderkey AS VARCHAR(20)) AS id, 's' || CAST(date_trunc('month', o_orderdate) AS VARCHAR(30)) AS snapshot_id,
  date_trunc('month', o_orderdate) AS fetched_at, 'U-' || CAST(o_custkey AS VARCHAR(20)) AS uuid,
  upper('aa:bb:' || CAST(o_custkey AS VARCHAR(20))) AS mac,
  CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 'Vendor ' || CAST(o_custkey % 6 AS VARCHAR(4)) END AS mac_vendor,
  '10.77.0.' || CAST(o_custkey % 250 AS VARCHAR(4)) AS ip,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Customer ' || CAST(o_custkey AS VARCHAR(20)) END AS friendly_name,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'cust-' || CAST(o_custkey % 100 AS VARCHAR(20)) END AS name
FROM @orders""",
    # Wireless clients of the same months: mixed-case addresses, NULL signal, several per
    # device, and as many of unknown devices.
    "wlan_client": """
SELECT 'w' || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(4)) AS id,
  's' || CAST(date_trunc('month', o_orderdate) AS VARCHAR(30)) AS snapshot_id, date_trunc('month', o_orderdate) AS fetched_at,
  CASE WHEN o_orderkey % 2 = 0 THEN 'AA:bb:' || CAST(o_custkey AS VARCHAR(20)) ELSE 'CC:dd:' || CAST(l_partkey AS VARCHAR(20)) END AS client_mac,
  CASE WHEN l_linenumber % 2 = 0 THEN 'RSN' ELSE CAST(l_linenumber * 100 AS VARCHAR(6)) END AS mcs,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE -30 - CAST(l_quantity AS INTEGER) END AS rssi
FROM @lineitem l JOIN @orders o ON l_orderkey = o_orderkey""",
    # Prefix blocks of 24, 28 and 36 bits (and one of 16) from the parts, as file lines.
    "vendor_line": """
SELECT p_partkey AS line_no,
  CASE p_partkey % 8
    WHEN 0 THEN '# ' || p_name
    WHEN 1 THEN 'BADLINE ' || p_name
    WHEN 2 THEN substr(hx, 1, 2) || ':' || substr(hx, 3, 2) || ':' || substr(hx, 5, 2) || ':00:00:00/28' || CHR(9) || 'Mid' || CHR(9) || p_name || ' 28'
    WHEN 3 THEN substr(hx, 1, 2) || ':' || substr(hx, 3, 2) || ':' || substr(hx, 5, 2) || ':12:30:00/36' || CHR(9) || 'Small' || CHR(9) || p_name || ' 36'
    WHEN 4 THEN substr(hx, 1, 2) || '-' || substr(hx, 3, 2) || '-' || substr(hx, 5, 2) || CHR(9) || ' ' || p_brand || ' '
    WHEN 5 THEN substr(hx, 1, 2) || ':' || substr(hx, 3, 2) || '/x' || CHR(9) || 'NoMask'
    WHEN 6 THEN substr(hx, 1, 2) || ':' || substr(hx, 3, 2) || ':' || substr(hx, 5, 2) || CHR(9) || 'Short' || CHR(9) || p_type
    ELSE lower(substr(hx, 1, 2) || substr(hx, 3, 2) || substr(hx, 5, 2)) || CHR(9) || p_brand || CHR(9) || ' ' END AS line
FROM (SELECT *, lpad(hex(p_partkey // 8), 6, '0') AS hx FROM @part) p""",
    # The same blocks as a table.
    "vendor": """
SELECT CASE p_partkey % 8 WHEN 2 THEN 28 WHEN 3 THEN 36 ELSE 24 END AS bits,
  lower(CASE p_partkey % 8 WHEN 2 THEN hx || '0' WHEN 3 THEN hx || '123' ELSE hx END) AS prefix,
  CASE p_partkey % 8 WHEN 2 THEN p_name || ' 28' WHEN 3 THEN p_name || ' 36' WHEN 6 THEN p_type ELSE p_brand END AS vendor,
  p_partkey AS line_no
FROM (SELECT *, lpad(hex(p_partkey // 8), 6, '0') AS hx FROM @part) p
WHERE p_partkey % 8 IN (2, 3, 4, 6, 7)""",
    # Addresses to look up: every line item as a host behind one of the blocks, some not MACs.
    "host": """
SELECT 'h' || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(4)) AS id,
  CASE l_linenumber WHEN 6 THEN 'not-a-host' WHEN 7 THEN NULL ELSE
    upper(substr(hx, 1, 2) || ':' || substr(hx, 3, 2) || ':' || substr(hx, 5, 2)) ||
    CASE l_suppkey % 3 WHEN 0 THEN ':12:3' || CAST(l_linenumber AS VARCHAR(1)) || ':01' WHEN 1 THEN ':0f:01:02' ELSE ':99:00:00' END END AS mac
FROM (SELECT *, lpad(hex(l_partkey // 8), 6, '0') AS hx FROM @lineitem) l""",
}

_CALLS = re.compile(r"@(\w+)")
# Each given table is one row group, which is one task; the larger ones are spread by key.
SPREAD = {"lineitem": "l_orderkey", "orders": "o_orderkey", "documents": "doc_id"}


def _scan(spark: SparkSession, sf_dir: str, name: str) -> str:
    tasks = spark.sparkContext.defaultParallelism
    hint = f"/*+ REPARTITION({tasks}, {SPREAD[name]}) */ " if name in SPREAD else ""
    return f"(SELECT {hint}* FROM parquet.`{sf_dir}/{name}.parquet`)"


def spark_sql(spark: SparkSession, name: str, sf_dir: str) -> str:
    return _CALLS.sub(lambda m: _scan(spark, sf_dir, m[1]), SQL[name].replace("//", "div"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture on Spark; times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.sql(spark_sql(spark, name, sf_dir))


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.sql(f"SELECT * FROM {_scan(spark, sf_dir, name)}")


def duck(name: str) -> str:
    """A fixture as a DuckDB subquery."""
    return "(" + _CALLS.sub(lambda m: m[1], SQL[name]) + ")"
