"""Registered queries: every operator over its whole inputs, with the SQL it is checked with.

Times leave as epoch milliseconds so that both engines give the same type. Predecessor oracles
use DuckDB's as-of join or correlated maxima, an independent way to the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import dumps as dm
from checks import fixtures as fx
from meshlens.functions.arrays import let
from meshlens.functions.macs import oui_of
from meshlens.functions.measures import in_window
from meshlens.functions.text import host_of
from meshlens.operators import extract as ex
from meshlens.operators import identity, names, sections, upsert, vendors
from meshlens.operators.predecessor import with_predecessor
from meshlens.plans import capture, panels, sketches, stored, views
from meshlens.sinks import buffer as buffer_sink
from meshlens.sinks import lake, messages
from meshlens.sources import buffer as buffer_source
from meshlens.sources import dumps as dump_source
from meshlens.sources import formats as fmt
from meshlens.sources import names as name_source
from meshlens.sources import vendors as vendor_source
from meshlens.sources.tables import conform
from meshlens.streaming import capture as stream_capture
from meshlens.streaming import ordered, rates, replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def in_ms(df: DataFrame) -> DataFrame:
    """Timestamps as epoch milliseconds."""
    return df.select(
        *(
            F.unix_millis(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema
        )
    )


# Oracle building blocks ------------------------------------------------------------------

RADIO = f"""
  SELECT coalesce(source_node_mac, 'master') AS node, source_node_name AS label, band, radio,
    epoch_ms(fetched_at) AS t,
    CAST(trunc(TRY_CAST(stats->>'tx_data_bytes' AS DOUBLE)) AS BIGINT) AS tx, CAST(trunc(TRY_CAST(stats->>'rx_data_bytes' AS DOUBLE)) AS BIGINT) AS rx,
    CAST(trunc(TRY_CAST(stats->>'tx_data_packets' AS DOUBLE)) AS BIGINT) AS pk, CAST(trunc(TRY_CAST(stats->>'tx_failures' AS DOUBLE)) AS BIGINT) AS fl,
    CAST(trunc(TRY_CAST(stats->>'rx_rssi' AS DOUBLE)) AS BIGINT) AS rssi, CAST(trunc(TRY_CAST(stats->>'self_bss_chan_util' AS DOUBLE)) AS BIGINT) AS self_util,
    CAST(trunc(TRY_CAST(stats->>'obss_chan_util' AS DOUBLE)) AS BIGINT) AS obss,
    CAST(trunc(TRY_CAST(stats->>'lithium_cycle_cnt_chan_nf_bdf_averaged_nf_dbm' AS DOUBLE)) AS BIGINT) AS noise
  FROM {fx.duck('radio_stats')} r"""


def mbps_sql(moved: str, ms: str) -> str:
    return (
        f"CAST(round(CAST(({moved}) * 8e0 / (({ms}) / 1e3) / 1e6 AS DECIMAL(38,12)), 4) AS DOUBLE)"
    )


V1 = f"""WITH s AS ({RADIO})
SELECT c.t AS fetched_at, c.t AS t_ms, coalesce(c.label, 'master') || ' ' || c.band || ' / ' || c.radio AS metric,
  {mbps_sql('c.tx - p.tx', 'c.t - p.t')} AS tx_mbps, {mbps_sql('c.rx - p.rx', 'c.t - p.t')} AS rx_mbps,
  c.rssi AS rx_rssi, c.noise AS noise_floor_dbm, c.rssi + c.noise AS snr_db_approx,
  c.self_util AS self_bss_util, c.obss AS obss_util,
  CAST(round(CAST(1e2 * (c.fl - p.fl) / nullif(c.pk - p.pk, 0) AS DECIMAL(38,12)), 3) AS DOUBLE) AS tx_fail_pct
FROM s c ASOF JOIN s p ON c.node = p.node AND c.band = p.band AND c.radio = p.radio AND c.t > p.t
WHERE c.tx >= p.tx"""

V2 = f"""SELECT epoch_ms(fetched_at) AS fetched_at, epoch_ms(fetched_at) AS t_ms, subnet,
  COUNT(DISTINCT mac) AS live_hosts, COUNT(*) FILTER (state = 'REACHABLE') AS reachable,
  COUNT(*) FILTER (state = 'STALE') AS stale, COUNT(*) FILTER (state IN ('DELAY', 'PROBE')) AS probing,
  COUNT(*) - COUNT(mac) AS unresolved
FROM (SELECT *, coalesce(map {{'br0': 'Main LAN', 'br1': 'Guest', 'br2': 'Smart Connect', 'eth0': 'WAN', 'eth1': 'WAN'}}[iface], iface) AS subnet
      FROM {fx.duck('ip_neighbor')} a WHERE family = 'inet') b
GROUP BY 1, 2, 3"""

V3 = f"""WITH nic AS (SELECT intf, epoch_ms(fetched_at) AS t, rx_bytes + tx_bytes AS b FROM {fx.duck('nic_counter')} n WHERE intf IN ('eth0', 'eth1')),
rad AS (SELECT node, radio, t, coalesce(tx, 0) + coalesce(rx, 0) AS b FROM ({RADIO}) r),
moved AS (
  SELECT c.t, 'Wired' AS category, c.b - p.b AS d, c.t - p.t AS ms FROM nic c ASOF JOIN nic p ON c.intf = p.intf AND c.t > p.t
  UNION ALL
  SELECT c.t, 'WiFi', c.b - p.b, c.t - p.t FROM rad c ASOF JOIN rad p ON c.node = p.node AND c.radio = p.radio AND c.t > p.t)
SELECT t AS fetched_at, t AS t_ms, category, {mbps_sql('SUM(d)', 'MAX(ms)')} AS mbps
FROM moved WHERE d >= 0 GROUP BY t, category"""

V4 = f"""WITH rad AS (SELECT node, coalesce(label, 'Router') AS label, radio, t, coalesce(tx, 0) AS tx, coalesce(rx, 0) AS rx FROM ({RADIO}) r)
SELECT c.t AS fetched_at, c.t AS t_ms, c.label AS node,
  {mbps_sql('SUM(c.tx - p.tx + c.rx - p.rx)', 'MAX(c.t - p.t)')} AS wifi_mbps,
  {mbps_sql('SUM(c.tx - p.tx)', 'MAX(c.t - p.t)')} AS tx_mbps,
  {mbps_sql('SUM(c.rx - p.rx)', 'MAX(c.t - p.t)')} AS rx_mbps
FROM rad c ASOF JOIN rad p ON c.node = p.node AND c.radio = p.radio AND c.t > p.t
WHERE c.tx >= p.tx AND c.rx >= p.rx
GROUP BY c.t, c.node, c.label"""

V5 = f"""WITH s AS (SELECT intf, epoch_ms(fetched_at) AS t, rx_bytes AS rx, tx_bytes AS tx FROM {fx.duck('nic_counter')} n)
SELECT c.t AS fetched_at, c.t AS t_ms, c.intf, c.rx AS rx_bytes, c.tx AS tx_bytes,
  c.rx - p.rx AS d_rx_bytes, c.tx - p.tx AS d_tx_bytes, (c.t - p.t) / 1e3 AS elapsed_secs,
  {mbps_sql('c.rx - p.rx', 'c.t - p.t')} AS rx_mbps, {mbps_sql('c.tx - p.tx', 'c.t - p.t')} AS tx_mbps
FROM s c ASOF JOIN s p ON c.intf = p.intf AND c.t > p.t
WHERE c.rx >= p.rx AND c.tx >= p.tx"""

NAME = "coalesce(nullif(friendly_name, ''), nullif(name, ''), mac_vendor, mac)"
LINKED = f"""FROM {fx.duck('device')} d LEFT JOIN {fx.duck('wlan_client')} w
  ON d.snapshot_id = w.snapshot_id AND lower(d.mac) = lower(w.client_mac)"""

# A window strictly inside the data: some predecessors lie before it.
FROM_MS, TO_MS = 1704844800000, 1705708800000  # 2024-01-10 .. 2024-01-20, inclusive


def over(view: str, columns: str, where: str = "") -> str:
    return f"SELECT {columns} FROM ({view}) v {where}"


WINDOW = f"WHERE t_ms BETWEEN {FROM_MS} AND {TO_MS}"


# Views -------------------------------------------------------------------------------------


@query("v1_radio_rates", V1)
def v1(spark, sf):
    return in_ms(views.radio_rates(fx.table(spark, sf, "radio_stats")))


@query("v2_neighbor_counts", V2)
def v2(spark, sf):
    return in_ms(views.neighbor_counts(fx.table(spark, sf, "ip_neighbor")))


@query("v3_wifi_vs_wired", V3)
def v3(spark, sf):
    nic, radio = fx.table(spark, sf, "nic_counter"), fx.table(spark, sf, "radio_stats")
    return in_ms(views.wifi_vs_wired(nic, radio))


@query("v4_node_wifi_rates", V4)
def v4(spark, sf):
    return in_ms(views.node_wifi_rates(fx.table(spark, sf, "radio_stats")))


@query("v5_nic_rates", V5)
def v5(spark, sf):
    return in_ms(views.nic_rates(fx.table(spark, sf, "nic_counter")))


# Panels ------------------------------------------------------------------------------------


def panel(name: str, run, inputs: list[str], oracle: str) -> None:
    def call(spark, sf):
        return in_ms(run(*(fx.table(spark, sf, t) for t in inputs)))

    query(name, oracle)(call)


QUALITY = "rx_rssi, noise_floor_dbm, snr_db_approx, self_bss_util, obss_util"
COUNTS = "live_hosts, reachable, stale, probing, unresolved"
for _name, _run, _inputs, _oracle in [
    ("q1_tx_rate", panels.q1_tx_rate, ["radio_stats"], over(V1, "t_ms AS time, metric, tx_mbps")),
    ("q2_rx_rate", panels.q2_rx_rate, ["radio_stats"], over(V1, "t_ms AS time, metric, rx_mbps")),
    ("q3_tx_failures", panels.q3_tx_failures, ["radio_stats"], over(V1, "t_ms AS time, metric, tx_fail_pct")),
    ("q4_link_quality", panels.q4_link_quality, ["radio_stats"], over(V1, f"t_ms AS time, metric, {QUALITY}")),
    ("q5_live_hosts", panels.q5_live_hosts, ["ip_neighbor"], over(V2, "t_ms AS time, subnet, live_hosts")),
    ("q6_reachable", panels.q6_reachable, ["ip_neighbor"], over(V2, "t_ms AS time, subnet, reachable")),
    ("q7_unresolved", panels.q7_unresolved, ["ip_neighbor"], over(V2, "t_ms AS time, subnet, unresolved")),
    ("q8_neighbor_counts", panels.q8_neighbor_counts, ["ip_neighbor"], over(V2, f"t_ms AS time, subnet, {COUNTS}")),
    (
        "q9_latest_neighbors", panels.q9_latest_neighbors, ["ip_neighbor"],
        f"""WITH n AS (SELECT * FROM {fx.duck('ip_neighbor')} a)
SELECT ip, coalesce(map {{'br0': 'Main LAN', 'br1': 'Guest', 'br2': 'Smart Connect', 'eth0': 'WAN', 'eth1': 'WAN'}}[iface], iface) AS subnet,
  mac, mac_vendor, is_router, state FROM n
WHERE family = 'inet' AND mac IS NOT NULL AND fetched_at = (SELECT max(fetched_at) FROM n)""",
    ),
    ("q10_wifi_vs_wired", panels.q10_wifi_vs_wired, ["nic_counter", "radio_stats"], over(V3, "t_ms AS time, category, mbps")),
    ("q11_wifi_vs_wired_all", panels.q11_wifi_vs_wired_all, ["nic_counter", "radio_stats"], over(V3, "fetched_at, category, mbps")),
    ("q12_node_wifi", panels.q12_node_wifi, ["radio_stats"], over(V4, "t_ms AS time, node, wifi_mbps")),
    ("q13_node_tx", panels.q13_node_tx, ["radio_stats"], over(V4, "t_ms AS time, node, tx_mbps")),
    ("q14_node_rx", panels.q14_node_rx, ["radio_stats"], over(V4, "t_ms AS time, node, rx_mbps")),
    ("q15_node_wifi_all", panels.q15_node_wifi_all, ["radio_stats"], over(V4, "fetched_at, node, wifi_mbps")),
    ("q16_nic_rates", panels.q16_nic_rates, ["nic_counter"], over(V5, "t_ms AS time, intf, rx_mbps, tx_mbps")),
    (
        "q17_nic_deltas", panels.q17_nic_deltas, ["nic_counter"],
        over(V5, "fetched_at, intf, d_rx_bytes, d_tx_bytes, elapsed_secs, rx_mbps, tx_mbps"),
    ),
    (
        "q18_device_links", panels.q18_device_links, ["device", "wlan_client"],
        f"SELECT epoch_ms(d.fetched_at) AS time, {NAME} AS name, ip, mcs, rssi {LINKED}",
    ),
    (
        "q19_device_rssi", panels.q19_device_rssi, ["device", "wlan_client"],
        f"SELECT epoch_ms(d.fetched_at) AS time, {NAME} AS name, rssi {LINKED} WHERE rssi IS NOT NULL",
    ),
    (
        "q20_latest_device_links", panels.q20_latest_device_links, ["device", "wlan_client"],
        f"SELECT {NAME} AS name, ip, mcs, rssi {LINKED} WHERE d.fetched_at = (SELECT max(fetched_at) FROM {fx.duck('device')} m)",
    ),
]:
    panel(_name, _run, _inputs, _oracle)


for _name, _run, _inputs, _oracle in [
    ("f3_window_node_wifi", panels.q12_node_wifi, ["radio_stats"], over(V4, "t_ms AS time, node, wifi_mbps", WINDOW)),
    ("f3_window_node_tx", panels.q13_node_tx, ["radio_stats"], over(V4, "t_ms AS time, node, tx_mbps", WINDOW)),
    ("f3_window_node_rx", panels.q14_node_rx, ["radio_stats"], over(V4, "t_ms AS time, node, rx_mbps", WINDOW)),
]:
    panel(_name, lambda table, run=_run: run(table, FROM_MS, TO_MS), _inputs, _oracle)


# Months of the orders: a window and an upper bound inside them.
ORDER_FROM_MS, ORDER_TO_MS = 757382400000, 820454400000  # 1994-01-01 .. 1996-01-01, inclusive
ORDER_WINDOW = f"epoch_ms(d.fetched_at) BETWEEN {ORDER_FROM_MS} AND {ORDER_TO_MS}"
for _name, _run, _inputs, _oracle in [
    (
        "f3_window_device_links", lambda d, w: panels.q18_device_links(d, w, ORDER_FROM_MS, ORDER_TO_MS), ["device", "wlan_client"],
        f"SELECT epoch_ms(d.fetched_at) AS time, {NAME} AS name, ip, mcs, rssi {LINKED} WHERE {ORDER_WINDOW}",
    ),
    (
        "f3_window_device_rssi", lambda d, w: panels.q19_device_rssi(d, w, ORDER_FROM_MS, ORDER_TO_MS), ["device", "wlan_client"],
        f"SELECT epoch_ms(d.fetched_at) AS time, {NAME} AS name, rssi {LINKED} WHERE rssi IS NOT NULL AND {ORDER_WINDOW}",
    ),
    (
        "f3_latest_device_links", lambda d, w: panels.q20_latest_device_links(d, w, ORDER_TO_MS), ["device", "wlan_client"],
        f"""SELECT {NAME} AS name, ip, mcs, rssi {LINKED}
WHERE d.fetched_at = (SELECT max(fetched_at) FROM {fx.duck('device')} m WHERE epoch_ms(fetched_at) <= {ORDER_TO_MS})""",
    ),
    (
        "f3_latest_neighbors", lambda n: panels.q9_latest_neighbors(n, TO_MS), ["ip_neighbor"],
        f"""WITH n AS (SELECT * FROM {fx.duck('ip_neighbor')} a WHERE epoch_ms(fetched_at) <= {TO_MS})
SELECT ip, coalesce(map {{'br0': 'Main LAN', 'br1': 'Guest', 'br2': 'Smart Connect', 'eth0': 'WAN', 'eth1': 'WAN'}}[iface], iface) AS subnet,
  mac, mac_vendor, is_router, state FROM n
WHERE family = 'inet' AND mac IS NOT NULL AND fetched_at = (SELECT max(fetched_at) FROM n)""",
    ),
]:
    panel(_name, _run, _inputs, _oracle)


# Filters, joins, aggregates ----------------------------------------------------------------


@query("f3_window_radio_rates", over(V1, "*", WINDOW))
def f3_radio(spark, sf):
    span = views.Span(from_ms=FROM_MS, to_ms=TO_MS)
    return in_ms(views.radio_rates(fx.table(spark, sf, "radio_stats"), span))


@query("f3_window_wifi_vs_wired", over(V3, "t_ms AS time, category, mbps", WINDOW))
def f3_wifi(spark, sf):
    nic, radio = fx.table(spark, sf, "nic_counter"), fx.table(spark, sf, "radio_stats")
    return in_ms(panels.q10_wifi_vs_wired(nic, radio, FROM_MS, TO_MS))


@query("f3_window_nic_rates", over(V5, "t_ms AS time, intf, rx_mbps, tx_mbps", WINDOW))
def f3_nic(spark, sf):
    return in_ms(panels.q16_nic_rates(fx.table(spark, sf, "nic_counter"), FROM_MS, TO_MS))


@query("f3_window_neighbor_counts", over(V2, "t_ms AS time, subnet, live_hosts", WINDOW))
def f3_neighbors(spark, sf):
    return in_ms(panels.q5_live_hosts(fx.table(spark, sf, "ip_neighbor"), FROM_MS, TO_MS))


@query(
    "j1_predecessor_time",
    f"""SELECT id, t_ms, prev_ms FROM (
  SELECT id, epoch_ms(fetched_at) AS t_ms,
    max(epoch_ms(fetched_at)) OVER (PARTITION BY intf ORDER BY epoch_ms(fetched_at) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ms
  FROM {fx.duck('nic_copies')} c) x WHERE prev_ms IS NOT NULL""",
)
def j1(spark, sf):
    rows = fx.table(spark, sf, "nic_copies").selectExpr(
        "id", "intf", "unix_millis(fetched_at) AS t_ms"
    )
    return with_predecessor(rows, ["intf"], [], paired=False).select("id", "t_ms", "prev_ms").distinct()


# Copies at one time: the plain self-join of every row with every row at the time before.
PAIRS = f"""WITH c AS (SELECT id, intf, epoch_ms(fetched_at) AS t, rx_bytes AS rx, tx_bytes AS tx FROM {fx.duck('nic_copies')} n),
t AS (SELECT intf, t, lag(t) OVER (PARTITION BY intf ORDER BY t) AS prev FROM (SELECT DISTINCT intf, t FROM c) d)
SELECT c.id, c.intf, c.t, p.t AS prev_ms, c.rx, c.tx, p.rx AS prev_rx, p.tx AS prev_tx
FROM c JOIN t ON c.intf = t.intf AND c.t = t.t JOIN c p ON p.intf = c.intf AND p.t = t.prev"""


@query("j2_predecessor_pairs", f"SELECT id, t AS t_ms, prev_ms, rx AS rx_bytes, prev_rx AS prev_rx_bytes, prev_tx AS prev_tx_bytes FROM ({PAIRS}) p")
def j2(spark, sf):
    rows = fx.table(spark, sf, "nic_copies").selectExpr(
        "id", "intf", "unix_millis(fetched_at) AS t_ms", "rx_bytes", "tx_bytes"
    )
    found = with_predecessor(rows, ["intf"], ["rx_bytes", "tx_bytes"])
    return found.select("id", "t_ms", "prev_ms", "rx_bytes", "prev_rx_bytes", "prev_tx_bytes")


_V5_COPIES = f"""SELECT t AS t_ms, intf, rx - prev_rx AS d_rx_bytes, tx - prev_tx AS d_tx_bytes, (t - prev_ms) / 1e3 AS elapsed_secs
FROM ({PAIRS}) p WHERE rx >= prev_rx AND tx >= prev_tx"""


@query("v5_nic_rates_copies", _V5_COPIES)
def v5_copies(spark, sf):
    rates_of = views.nic_rates(fx.table(spark, sf, "nic_copies"))
    return rates_of.select("t_ms", "intf", "d_rx_bytes", "d_tx_bytes", "elapsed_secs")


@query("f3_window_nic_rates_copies", over(_V5_COPIES, "*", WINDOW))
def f3_copies(spark, sf):
    span = views.Span(from_ms=FROM_MS, to_ms=TO_MS)
    rates_of = views.nic_rates(fx.table(spark, sf, "nic_copies"), span)
    return rates_of.select("t_ms", "intf", "d_rx_bytes", "d_tx_bytes", "elapsed_secs")


# Sites: the last digit of a row's id. Series and newest snapshots are each site's own.
BY_SITE = views.Span(by=("site",))


def _sited(spark, sf, table: str) -> DataFrame:
    return fx.table(spark, sf, table).withColumn("site", F.expr("right(id, 1)"))


@query(
    "v1_site_rates",
    f"""WITH s AS (SELECT x.*, right(id, 1) AS site FROM (SELECT r.id, q.* FROM {fx.duck('radio_stats')} r JOIN
  (SELECT id AS key, y.* EXCLUDE (id) FROM ({RADIO.replace("SELECT coalesce", "SELECT id, coalesce", 1)}) y) q ON r.id = q.key) x)
SELECT c.site, c.t AS t_ms, coalesce(c.label, 'master') || ' ' || c.band || ' / ' || c.radio AS metric,
  {mbps_sql('c.tx - p.tx', 'c.t - p.t')} AS tx_mbps, {mbps_sql('c.rx - p.rx', 'c.t - p.t')} AS rx_mbps
FROM s c ASOF JOIN s p ON c.site = p.site AND c.node = p.node AND c.band = p.band AND c.radio = p.radio AND c.t > p.t
WHERE c.tx >= p.tx""",
)
def v1_site(spark, sf):
    found = views.radio_rates(_sited(spark, sf, "radio_stats"), BY_SITE)
    return found.select("site", "t_ms", "metric", "tx_mbps", "rx_mbps")


_SITE_PAIRS = PAIRS.replace("SELECT id, intf,", "SELECT id, right(id, 1) AS site, intf,").replace(
    "SELECT intf, t, lag(t) OVER (PARTITION BY intf ORDER BY t) AS prev FROM (SELECT DISTINCT intf, t FROM c) d",
    "SELECT site, intf, t, lag(t) OVER (PARTITION BY site, intf ORDER BY t) AS prev FROM (SELECT DISTINCT site, intf, t FROM c) d",
).replace("SELECT c.id, c.intf", "SELECT c.id, c.site, c.intf").replace(
    "ON c.intf = t.intf AND c.t = t.t JOIN c p ON p.intf", "ON c.site = t.site AND c.intf = t.intf AND c.t = t.t JOIN c p ON p.site = c.site AND p.intf"
)


@query(
    "v5_site_rates",
    f"""SELECT site, t AS t_ms, intf, rx - prev_rx AS d_rx_bytes, tx - prev_tx AS d_tx_bytes, (t - prev_ms) / 1e3 AS elapsed_secs
FROM ({_SITE_PAIRS}) p WHERE rx >= prev_rx AND tx >= prev_tx""",
)
def v5_site(spark, sf):
    found = views.nic_rates(_sited(spark, sf, "nic_copies"), BY_SITE)
    return found.select("site", "t_ms", "intf", "d_rx_bytes", "d_tx_bytes", "elapsed_secs")


@query(
    "q9_site_neighbors",
    f"""WITH n AS (SELECT *, right(id, 1) AS site FROM {fx.duck('ip_neighbor')} a WHERE epoch_ms(fetched_at) <= {TO_MS})
SELECT site, ip, coalesce(map {{'br0': 'Main LAN', 'br1': 'Guest', 'br2': 'Smart Connect', 'eth0': 'WAN', 'eth1': 'WAN'}}[iface], iface) AS subnet,
  mac, mac_vendor, is_router, state FROM n JOIN (SELECT site AS s, max(fetched_at) AS newest FROM n GROUP BY 1) m ON site = s
WHERE family = 'inet' AND mac IS NOT NULL AND fetched_at = newest""",
)
def q9_site(spark, sf):
    return panels.q9_latest_neighbors(_sited(spark, sf, "ip_neighbor"), TO_MS, ("site",))


@query(
    "a2_sketched_hosts",
    f"""SELECT epoch_ms(date_trunc('week', fetched_at)) AS week, subnet, COUNT(DISTINCT mac) AS live_hosts, TRUE AS within
FROM (SELECT *, coalesce(map {{'br0': 'Main LAN', 'br1': 'Guest', 'br2': 'Smart Connect', 'eth0': 'WAN', 'eth1': 'WAN'}}[iface], iface) AS subnet
      FROM {fx.duck('ip_neighbor')} a WHERE family = 'inet') b GROUP BY 1, 2""",
)
def a2_sketched(spark, sf):
    """Sketches of every snapshot, stored and rolled up to weeks, beside the exact counts."""
    rows = fx.table(spark, sf, "ip_neighbor")
    folder = lake.shared_folder(spark, "sketches")
    sketches.neighbor_sketches(rows).write.parquet(folder)
    rolled = sketches.live_hosts(spark.read.parquet(folder), "week")
    exact = (
        rows.where(F.col("family") == views.IPV4)
        .groupBy(F.date_trunc("week", "fetched_at").alias("span"), views.subnet_of().alias("subnet"))
        .agg(F.count_distinct("mac").alias("exact"))
    )
    same = (rolled["span"] == exact["span"]) & rolled["subnet"].eqNullSafe(exact["subnet"])
    both = rolled.join(exact, same).select(rolled["span"].alias("week"), rolled["subnet"], "live_hosts", "exact")
    error = F.abs(F.col("live_hosts") - F.col("exact")) / F.greatest("exact", F.lit(1))
    return in_ms(both.select("week", "subnet", F.col("exact").alias("live_hosts"), (error <= sketches.ERROR).alias("within")))


@query(
    "a10_name_coverage",
    f"""SELECT snapshot_id, COUNT(nullif(friendly_name, '')) AS named, COUNT(*) AS devices
FROM {fx.duck('device')} d GROUP BY snapshot_id""",
)
def a10(spark, sf):
    return names.name_coverage(fx.table(spark, sf, "device"))


# Dumps -------------------------------------------------------------------------------------

_RAW = """SELECT 'doc' || CAST(doc_id AS VARCHAR(20)) AS snapshot_id, doc_id AS d, text, n_chars FROM documents"""


@query("s1_landed_dumps", "SELECT 'doc' || CAST(doc_id AS VARCHAR(20)) AS snapshot_id, epoch_ms(make_timestamp((1959822461 + doc_id * 600) * 1000000)) AS fetched_at, CAST(NULL AS VARCHAR) AS source_ip, text FROM documents")
def s1(spark, sf):
    docs = dm.documents(spark, sf)
    root = lake.shared_folder(spark, "landed")
    # A folder per dump is slow to commit on a local disk; tasks commit their own here.
    direct = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    dump_source.land_dumps(dm.as_dump(docs, "CAST(NULL AS STRING)", "text"), root, **direct)
    read = dump_source.read_dumps(spark, root)
    # The writer ends every file with a line break of its own.
    return in_ms(read.withColumn("text", F.expr("substring(text, 1, length(text) - 1)")))


@query(
    "s2_complete_dumps",
    f"""SELECT snapshot_id, length(text) + 1 + CASE WHEN d % 4 = 0 THEN length('no clock') WHEN d % 4 = 1 THEN length('page generated on Monday')
  ELSE length(' Page generated on Mon Feb 09 03:07:41 UTC 2032') END + 1 + length('page generated on Fri Jan 02 00:00:00 UTC 1970') + 1 + length('{fmt.END_OF_DUMP}') AS n_chars
FROM ({_RAW}) r WHERE d % 5 != 0""",
)
def s2(spark, sf):
    kept = dump_source.complete_dumps(dm.raw_dumps(spark, sf))
    return kept.select("snapshot_id", F.length("text").cast("bigint").alias("n_chars"))


@query("s2_incomplete_dumps", f"SELECT snapshot_id FROM ({_RAW}) r WHERE d % 5 = 0")
def s2_rest(spark, sf):
    return capture.quarantine(dm.raw_dumps(spark, sf)).select("snapshot_id")


@query(
    "s3_generated_at",
    f"""SELECT snapshot_id, CASE d % 4 WHEN 0 THEN epoch_ms(TIMESTAMP '1970-01-02 00:00:00') WHEN 1 THEN NULL
  ELSE epoch_ms(TIMESTAMP '2032-02-01 03:07:00') + (d % 28) * 86400000 + (d % 60) * 1000 END AS generated_at
FROM ({_RAW}) r""",
)
def s3(spark, sf):
    clock = dump_source.generated_at().alias("generated_at")
    return in_ms(dm.raw_dumps(spark, sf).select("snapshot_id", clock))


SATELLITE = "SELECT doc_id AS d, n_chars AS n, lang, source, 1 AS i FROM documents"


def known(value: str) -> str:
    """A satellite's tag: a document with one device alone has no second node."""
    return f"CASE WHEN i = 1 AND d % 5 = 0 THEN NULL ELSE {value} END"


@query(
    "s4_mesh_dumps",
    f"""SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, NULL AS source_ip, NULL AS node_uuid FROM (SELECT doc_id AS d FROM documents) a
UNION ALL SELECT 'doc' || CAST(d AS VARCHAR(20)), {dm.IP}, {known(dm.UUID)} FROM ({SATELLITE}) b""",
)
def s4(spark, sf):
    masters = dm.master_dumps(spark, sf)
    dumps = masters.unionByName(dm.satellite_dumps(spark, sf))
    nodes = ex.extract(masters, "node")
    return dump_source.mesh_dumps(dumps, nodes).select("snapshot_id", "source_ip", "node_uuid")


JSON_COLUMNS = {
    "radio_stats": ("stats", ["tx_data_bytes", "rx_rssi", "obss_chan_util", "tx_per_ac_best_effort", "rx_per_ac_best_effort", "noise_dbm"]),
    "radio_config": ("settings", ["chwidth", "mode", "disablecoext"]),
    "lldp_neighbor": ("capabilities", ["Bridge", "Station"]),
}


def extraction(key: str, table: str) -> None:
    def call(spark, sf):
        rows = ex.extract(dm.master_dumps(spark, sf), table)
        if table == "device":
            rows = rows.withColumn("extra_macs", F.array_join("extra_macs", ","))
        if table in JSON_COLUMNS:
            column, keys = JSON_COLUMNS[table]
            values = F.from_json(column, "map<string,string>")
            rows = rows.withColumn("_v", values).select(
                "*", *(F.col("_v")[k].alias(k.lower()) for k in keys)
            )
        if table == "node":
            keys = F.size(F.json_object_keys("devinfo")).cast("bigint")
            rows = rows.withColumn("info_nested", F.get_json_object("devinfo", "$.list[1].a")).withColumn("info_keys", keys)
        return rows.select("snapshot_id", *dm.ROWS[table])

    query(key, dm.expected(table))(call)


for _key, _table in [
    ("e3_device", "device"),
    ("e4_wlan_client", "wlan_client"),
    ("e5_backhaul", "backhaul"),
    ("e7_node", "node"),
    ("e8_radio_stats", "radio_stats"),
    ("e9_radio_config", "radio_config"),
    ("e10_nic_counter", "nic_counter"),
    ("e11_system", "system"),
    ("e12_ip_neighbor", "ip_neighbor"),
    ("e13_ping", "ping"),
    ("e14_lldp_neighbor", "lldp_neighbor"),
]:
    extraction(_key, _table)


def _with_lines(spark, sf) -> DataFrame:
    return ex.with_lines(dm.master_dumps(spark, sf)).select("snapshot_id", "lines")


@query(
    "e0_table_rows",
    """SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, CAST(k + SUM((d + i) % 3) AS BIGINT) AS device_rows, k AS backhaul_rows
FROM (SELECT doc_id AS d, 1 + doc_id % 5 AS k, unnest(range(1 + doc_id % 5)) AS i FROM documents) x GROUP BY d, k""",
)
def e0(spark, sf):
    device = sections.dashed_table("lines", fmt.DEVICE_MARKER, fmt.DEVICE_ROW)
    backhaul = sections.dashed_table("lines", fmt.BACKHAUL_MARKER, fmt.BACKHAUL_ROW)
    return _with_lines(spark, sf).selectExpr(
        "snapshot_id",
        f"bigint(size({device}.rows)) AS device_rows",
        f"bigint(size({backhaul}.rows)) AS backhaul_rows",
    )


@query(
    "e1_titled_sections",
    """SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, i AS nth,
  '------------- ath' || CAST(i AS VARCHAR(5)) || ' Settings -------------' AS title, CAST(6 AS BIGINT) AS body_lines
FROM (SELECT doc_id AS d, unnest(range(1 + doc_id % 5)) AS i FROM documents) x""",
)
def e1(spark, sf):
    found = F.expr(sections.titled_sections("lines", fmt.CONFIG_TITLE))
    return _with_lines(spark, sf).select("snapshot_id", F.posexplode(found)).selectExpr(
        "snapshot_id", "bigint(pos) AS nth", "col.title", "bigint(size(col.body)) AS body_lines"
    )


@query(
    "e2_fixed_width",
    "WITH x AS (" + dm.expected("backhaul") + """)
SELECT snapshot_id, node_mac, node_ip, parent_ip, rssi AS signal, CAST(speed AS VARCHAR) AS speed, CAST("timestamp" AS VARCHAR) AS stamp FROM x""",
)
def e2(spark, sf):
    table = sections.dashed_table("lines", fmt.BACKHAUL_MARKER, fmt.BACKHAUL_ROW)
    rows = F.expr(let(table, sections.fixed_width_rows))
    return _with_lines(spark, sf).select("snapshot_id", F.explode(rows).alias("r")).selectExpr(
        "snapshot_id", "r.cells[0] AS node_mac", "r.cells[1] AS node_ip",
        "r.cells[2] AS parent_ip", "r.cells[5] AS signal", "r.cells[6] AS speed",
        "r.cells[8] AS stamp",
    )


@query(
    "e6_devinfo",
    f"""SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, {dm.UUID} AS uuid, {dm.ROWS['node']['sku']} AS sku, '}}' AS nested
FROM (SELECT doc_id AS d, n_chars AS n, lang, source, unnest(range(1 + doc_id % 5)) AS i FROM documents) x WHERE {dm.HAS_INFO}""",
)
def e6(spark, sf):
    infos = F.expr(ex.devinfo_section("lines"))
    return _with_lines(spark, sf).select("snapshot_id", F.explode(infos).alias("o")).selectExpr(
        "snapshot_id", "o.uuid", "get_json_object(o.data, '$.SKU') AS sku",
        "get_json_object(o.data, '$.list[1].a') AS nested",
    )


def _mesh(spark, sf) -> DataFrame:
    return dm.master_dumps(spark, sf).unionByName(dm.satellite_dumps(spark, sf))


_TAGS = "source_node_mac, source_node_name, source_node_ip, source_role"
_MASTER_ROW = "SELECT doc_id AS d, n_chars AS n, lang, source, 0 AS i FROM documents"


@query(
    "e15_source_tags",
    f"""SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, CAST(903552 + d AS BIGINT) AS mem_total,
  {known(dm.NODE_MAC)} AS source_node_mac, {known(dm.NAME)} AS source_node_name, {known(dm.DEVICE_IP)} AS source_node_ip, {known(dm.ROLE)} AS source_role
FROM ({_MASTER_ROW} UNION ALL {SATELLITE}) x""",
)
def e15(spark, sf):
    extracted = ex.sections(_mesh(spark, sf), ["node", "system"])
    rows = identity.tag_source(
        ex.section_rows(extracted, "system"), ex.section_rows(extracted, "node")
    )
    return rows.select("snapshot_id", "mem_total", *_TAGS.split(", "))


@query(
    "e16_row_ids",
    """SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, i AS pos,
  sha256('doc' || CAST(d AS VARCHAR(20)) || '|nic_counter||' || CAST(i AS VARCHAR(5))) AS id
FROM (SELECT doc_id AS d, unnest(range(1 + doc_id % 5)) AS i FROM documents) x""",
)
def e16(spark, sf):
    rows = identity.with_ids(ex.extract(dm.master_dumps(spark, sf), "nic_counter"), "nic_counter")
    return rows.select("snapshot_id", F.col("pos").cast("bigint").alias("pos"), "id")


@query(
    "s8_capture_system",
    f"""SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, (1959822461 + d * 600) * 1000 AS fetched_at, {dm.ROWS['system']['uptime_secs']} AS uptime_secs,
  {known(dm.NODE_MAC)} AS source_node_mac, {known(dm.ROLE)} AS source_role
FROM ({_MASTER_ROW} UNION ALL {SATELLITE}) x""",
)
def s8(spark, sf):
    tables_ = capture.capture(_mesh(spark, sf))
    return in_ms(
        tables_["system"].select(
            "snapshot_id", "fetched_at", "uptime_secs", "source_node_mac", "source_role"
        )
    )


# Enrichment --------------------------------------------------------------------------------

_VENDOR = f"SELECT bits, prefix, arg_max(vendor, line_no) AS vendor FROM {fx.duck('vendor')} v GROUP BY bits, prefix"
_HEX = "lower(regexp_replace(coalesce(mac, ''), '[^0-9a-fA-F]', '', 'g'))"
_OUI = f"(SELECT prefix, vendor FROM ({_VENDOR}) a WHERE bits = 24)"


def _vendors(spark, sf) -> DataFrame:
    lines = fx.table(spark, sf, "vendor_line")
    return vendor_source.parse_vendor_lines(lines)


@query("s6_vendor_lines", _VENDOR)
def s6(spark, sf):
    return _vendors(spark, sf).select("bits", "prefix", "vendor")


@query("s7_no_vendor_file", f"SELECT id, mac, CAST(NULL AS VARCHAR) AS mac_vendor FROM {fx.duck('host')} h")
def s7(spark, sf):
    """Without a vendor file every vendor is unknown, and nothing fails."""
    missing = vendor_source.read_vendor_file(spark, f"{sf}/no-such-vendor-file")
    ouis = vendors.oui_table(missing)
    return vendors.with_vendor(fx.table(spark, sf, "host"), ouis, "mac", "mac_vendor").select("id", "mac", "mac_vendor")


@query(
    "n7_oui_table",
    f"""SELECT upper(left(prefix, 2) || ':' || substr(prefix, 3, 2) || ':' || substr(prefix, 5, 2)) AS oui, vendor FROM {_OUI} o""",
)
def n7(spark, sf):
    blocks = vendors.oui_table(_vendors(spark, sf)).where(f"length(prefix) = {vendors.OUI_NIBBLES}")
    return blocks.select(F.expr(oui_of("prefix")).alias("oui"), "vendor")


@query(
    "n1_vendor_by_oui",
    f"""SELECT id, mac, vendor AS mac_vendor FROM {fx.duck('host')} h LEFT JOIN {_OUI} o
  ON length({_HEX}) >= 6 AND left({_HEX}, 6) = o.prefix""",
)
def n1(spark, sf):
    ouis = vendors.oui_table(_vendors(spark, sf))
    return vendors.with_vendor(fx.table(spark, sf, "host"), ouis, "mac", "mac_vendor").select(
        "id", "mac", "mac_vendor"
    )


@query(
    "n2_longest_prefix",
    f"""SELECT mac, arg_max(vendor, bits) AS vendor FROM (SELECT DISTINCT mac, {_HEX} AS hx FROM {fx.duck('host')} h WHERE mac IS NOT NULL) m
  LEFT JOIN ({_VENDOR}) v ON v.prefix = left(m.hx, length(v.prefix)) GROUP BY mac""",
)
def n2(spark, sf):
    return vendors.longest_prefix(fx.table(spark, sf, "host"), _vendors(spark, sf))


@query(
    "n3_vendor_columns",
    f"""SELECT id, o.vendor AS chassis_id_vendor, q.vendor AS port_id_vendor FROM (SELECT id, {_HEX} AS hx FROM {fx.duck('host')} h) m
  LEFT JOIN {_OUI} o ON length(hx) >= 6 AND left(hx, 6) = o.prefix
  LEFT JOIN {_OUI} q ON length(hx) >= 6 AND '0' || left(hx, 5) = q.prefix""",
)
def n3(spark, sf):
    rows = fx.table(spark, sf, "host").selectExpr(
        "id", "mac AS chassis_id", "'0' || replace(mac, ':', '') AS port_id"
    )
    filled = vendors.with_vendors(rows, vendors.oui_table(_vendors(spark, sf)), "lldp_neighbor")
    return filled.select("id", "chassis_id_vendor", "port_id_vendor")


_ARRAYS = """SELECT l_orderkey, l_linenumber, lpad(hex(l_partkey // 8), 6, '0') AS hx,
  lpad(hex(l_suppkey), 6, '0') AS hy FROM lineitem"""


@query(
    "n4_vendor_arrays",
    f"""SELECT l_orderkey AS k, l_linenumber AS ln,
  CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN coalesce(a.vendor, '-') ELSE coalesce(a.vendor, '-') || ',-,' || coalesce(b.vendor, '-') END AS found
FROM ({_ARRAYS}) x LEFT JOIN {_OUI} a ON lower(hx) = a.prefix LEFT JOIN {_OUI} b ON lower(hy) = b.prefix""",
)
def n4(spark, sf):
    rows = fx.source(spark, sf, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber) AS id", "l_orderkey AS k", "l_linenumber AS ln",
        "lpad(hex(l_partkey div 8), 6, '0') AS hx", "lpad(hex(l_suppkey), 6, '0') AS hy",
    ).selectExpr(
        "id", "k", "ln",
        "CASE WHEN ln = 1 THEN NULL WHEN ln = 2 THEN array(hx) ELSE array(hx, 'zz:zz', hy) END AS extra_macs",
    )
    ouis = vendors.oui_table(_vendors(spark, sf))
    filled = vendors.with_vendor_array(rows, ouis, "extra_macs", "extra_macs_vendor")
    return filled.select("k", "ln", F.array_join("extra_macs_vendor", ",", "-").alias("found"))


# Name payloads: one per order with three devices, some refused, some devices without a name.
_DEV = "'Dev-' || CAST(o AS VARCHAR(20)) || '-' || CAST(j AS VARCHAR(3))"
_MAC = "'aa:00:' || CAST(o AS VARCHAR(20)) || ':' || CAST({0} AS VARCHAR(3))"
_PAYLOAD_NAME = "CASE (o + j) % 4 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' Name ' || CAST(o AS VARCHAR(20)) || '-' || CAST(j AS VARCHAR(3)) END"
_INDEX = f"""SELECT 's' || CAST(o AS VARCHAR(20)) AS snapshot_id, key, arg_min(trim(nm), j * 10 + nth) AS name FROM (
  SELECT o, j, {_PAYLOAD_NAME} AS nm, unnest([lower({_DEV}), upper({_MAC.format('j')}), upper({_MAC.format('j + 1')})]) AS key, unnest([0, 1, 2]) AS nth
  FROM (SELECT o_orderkey AS o, unnest(range(3)) AS j FROM orders WHERE o_orderkey % 11 != 0) a) b
WHERE trim(coalesce(nm, '')) != '' GROUP BY 1, 2"""


def _payloads(spark, sf) -> DataFrame:
    device = (
        f"named_struct('deviceID', {_DEV}, 'friendlyName', {_PAYLOAD_NAME}, 'knownInterfaces',"
        f" array(named_struct('macAddress', {_MAC.format('j')}), named_struct('macAddress', {_MAC.format('j + 1')})))"
    )
    raw = fx.source(spark, sf, "orders").selectExpr("o_orderkey AS o").selectExpr(
        "concat('s', o) AS snapshot_id",
        "to_json(named_struct('result', IF(o % 11 = 0, 'ErrorUnknown', 'OK'), 'output',"
        f" named_struct('devices', transform(sequence(0, 2), j -> {device})))) AS payload",
    )
    return name_source.parse_payloads(raw)


@query("s5_name_payloads", "SELECT 's' || CAST(o_orderkey AS VARCHAR(20)) AS snapshot_id, CAST(3 AS BIGINT) AS devices FROM orders WHERE o_orderkey % 11 != 0")
def s5(spark, sf):
    return _payloads(spark, sf).select(
        "snapshot_id", F.size("devices").cast("bigint").alias("devices")
    )


@query("n5_name_index", _INDEX)
def n5(spark, sf):
    return names.name_index(_payloads(spark, sf))


@query(
    "n6_friendly_names",
    f"""WITH idx AS ({_INDEX}),
dev AS (SELECT o, j, 's' || CAST(o AS VARCHAR(20)) AS snapshot_id,
  unnest([CASE WHEN j % 2 = 0 THEN lower({_DEV}) ELSE 'unknown' END, upper({_MAC.format('j')}), upper({_MAC.format('j + 2')})]) AS key, unnest([0, 1, 2]) AS nth
  FROM (SELECT o_orderkey AS o, unnest(range(4)) AS j FROM orders) a)
SELECT CAST(o AS VARCHAR(20)) || '-' || CAST(j AS VARCHAR(3)) AS id, arg_min(name, nth) FILTER (name IS NOT NULL) AS friendly_name
FROM dev LEFT JOIN idx USING (snapshot_id, key) GROUP BY o, j""",
)
def n6(spark, sf):
    devices = fx.source(spark, sf, "orders").selectExpr(
        "o_orderkey AS o", "explode(sequence(0, 3)) AS j"
    ).selectExpr(
        "concat(o, '-', j) AS id", "concat('s', o) AS snapshot_id",
        f"CASE WHEN j % 2 = 0 THEN upper({_DEV}) ELSE 'UNKNOWN' END AS uuid",
        f"{_MAC.format('j')} AS mac", f"array({_MAC.format('j + 2')}) AS extra_macs",
    )
    maps = names.name_maps(_payloads(spark, sf))
    return names.with_friendly_names(devices, maps).select("id", "friendly_name")


# Identity, messages, buffer, upsert ----------------------------------------------------------


def _sent(spark, sf, marked: bool = False) -> DataFrame:
    wanted = ["nic_counter", "radio_stats", "device"]
    return messages.all_messages(
        {t: fx.table(spark, sf, t) for t in wanted}, marked_time=marked
    )


_SENT = " UNION ALL ".join(
    f"SELECT 'mesh.{t}' AS topic, id, snapshot_id AS key, epoch_ms(fetched_at) AS at, {extra} AS detail, CAST({n} AS BIGINT) AS fields FROM {fx.duck(t)} x"
    for t, extra, n in [
        ("nic_counter", "CAST(rx_bytes AS VARCHAR)", 6),
        ("radio_stats", "stats->>'tx_data_bytes'", 10),
        ("device", "mac", 15),
    ]
)


@query("k1_messages", _SENT)
def k1(spark, sf):
    field = lambda f: F.get_json_object("value", f"$.{f}")
    detail = F.coalesce(
        field("rx_bytes"), F.get_json_object(field("stats"), "$.tx_data_bytes"), field("mac")
    )
    return _sent(spark, sf).select(
        "topic", field("id").alias("id"), "key", field("fetched_at").cast("bigint").alias("at"),
        detail.alias("detail"), F.size(F.json_object_keys("value")).cast("bigint").alias("fields"),
    )


@query(
    "k2_object_columns",
    f"""SELECT id, stats->>'rx_rssi' AS rx_rssi, source_node_mac FROM {fx.duck('radio_stats')} r""",
)
def k2(spark, sf):
    sent = messages.messages(fx.table(spark, sf, "radio_stats"), "radio_stats")
    rows, _ = messages.parse_messages(sent, "radio_stats")
    return rows.select("id", F.get_json_object("stats", "$.rx_rssi").alias("rx_rssi"), "source_node_mac")


@query("a9_message_counts", f"SELECT topic, COUNT(*) AS messages FROM ({_SENT}) s GROUP BY topic")
def a9(spark, sf):
    return messages.message_counts(_sent(spark, sf))


@query(
    "k3_upsert",
    f"""SELECT id, intf, rx_bytes, tx_bytes + 2 AS tx_bytes FROM {fx.duck('nic_copies')} a
UNION ALL SELECT id || '-new', intf, rx_bytes, tx_bytes FROM {fx.duck('nic_copies')} b""",
)
def k3(spark, sf):
    target = fx.table(spark, sf, "nic_copies")
    again = lambda n: target.withColumn("tx_bytes", F.col("tx_bytes") + n).withColumn(
        "arrival", F.lit(n).cast("bigint")
    )
    added = target.withColumn("id", F.concat("id", F.lit("-new"))).withColumn(
        "arrival", F.lit(3).cast("bigint")
    )
    arrivals = again(2).unionByName(again(1)).unionByName(added)
    return upsert.upsert(target, arrivals).select("id", "intf", "rx_bytes", "tx_bytes")


@query(
    "k5_dead_letters",
    f"""SELECT 'row' AS kind, id AS what FROM {fx.duck('nic_copies')} a
UNION ALL SELECT 'dead', 'broken ' || id FROM {fx.duck('nic_copies')} b""",
)
def k5(spark, sf):
    rows = fx.table(spark, sf, "nic_copies")
    good = messages.messages(rows, "nic_counter")
    broken = good.withColumn(
        "value", F.concat(F.lit("broken "), F.get_json_object("value", "$.id"))
    )
    kept, dead = messages.parse_messages(good.unionByName(broken), "nic_counter")
    return kept.select(F.lit("row").alias("kind"), F.col("id").alias("what")).unionByName(
        dead.select(F.lit("dead").alias("kind"), F.col("value").alias("what"))
    )


@query(
    "k6_added_columns",
    f"""SELECT id, intf, rx_bytes, NULL AS mtu FROM {fx.duck('nic_copies')} a
UNION ALL SELECT id || '-v2', intf, rx_bytes, CAST(1500 AS BIGINT) FROM {fx.duck('nic_copies')} b""",
)
def k6(spark, sf):
    old = fx.table(spark, sf, "nic_copies").select("id", "intf", "rx_bytes")
    new = old.withColumn("id", F.concat("id", F.lit("-v2"))).withColumn(
        "mtu", F.lit(1500).cast("bigint")
    )
    return upsert.evolve(old, new)


@query(
    "s9_buffer_roundtrip",
    f"""SELECT 'mesh.nic_counter' AS topic, id, snapshot_id, epoch_ms(fetched_at) AS fetched_at, intf, rx_bytes, tx_bytes FROM {fx.duck('nic_copies')} a""",
)
def s9(spark, sf):
    path = lake.shared_folder(spark, "buffer")
    sent = messages.messages(fx.table(spark, sf, "nic_copies"), "nic_counter", marked_time=True)
    buffer_sink.write_buffer(sent, path)
    rows, _ = messages.parse_messages(buffer_source.read_buffer(spark, path), "nic_counter")
    return in_ms(rows).select(F.lit("mesh.nic_counter").alias("topic"), "*")


@query(
    "x8_url_host",
    "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages",
)
def x8(spark, sf):
    return fx.source(spark, sf, "pages").selectExpr("page_id", f"{host_of('url')} AS host")


# Streams -------------------------------------------------------------------------------------


@query("k8_replay", f"SELECT topic, COUNT(*) AS messages FROM ({_SENT}) s GROUP BY topic")
def k8(spark, sf):
    """Buffer three tables twice (every message redelivered), replay them, count what is stored."""
    path, store = lake.shared_folder(spark, "buffer"), lake.shared_folder(spark, "lake")
    sent = _sent(spark, sf, marked=True)
    buffer_sink.write_buffer(sent, path)
    buffer_sink.write_buffer(sent, path)
    stream = buffer_source.stream_buffer(spark, path, files_per_batch=20)
    replay.replay(stream, store, f"{store}/_checkpoint").awaitTermination()
    stored = messages.all_messages(
        {t: lake.read_table(spark, store, t) for t in ("nic_counter", "radio_stats", "device")}
    )
    return messages.message_counts(stored)


_REPLAY_PART = "CAST(rx_bytes // 1000 % 6 AS INTEGER)"


def _ordered_replay(spark, sf) -> tuple[str, list]:
    """Six files written against the order of their names; the fourth fails in the first run, the second takes two."""
    folder, store = lake.shared_folder(spark, "buffer"), lake.shared_folder(spark, "lake")
    rows = conform(fx.table(spark, sf, "nic_copies"), "nic_counter")
    part = F.expr(_REPLAY_PART.replace("//", "div"))
    # Every file also has the rows of the file before it, with another value: the later name counts.
    for k in reversed(range(6)):
        own = rows.where(part.isin(k, k - 1)).withColumn("tx_bytes", F.col("tx_bytes") + k)
        sent = messages.messages(own, "nic_counter", marked_time=True).coalesce(1)
        buffer_sink.write_files(sent, folder, datetime(2026, 6, 25, 9, 0, k))
    ledger = f"{store}/_ledger"
    down = {"mesh.nic_counter.20260625_090003"}

    def deliver(batch: DataFrame, step: int) -> None:
        found = {r.arrival for r in batch.select("arrival").distinct().collect()}
        if found & down:
            raise ConnectionError("broker is down")
        replay.store_messages(batch, step, store, writer="ordered")

    reports = [ordered.drain(spark, folder, ledger, deliver)]
    down.clear()
    reports.append(ordered.drain(spark, folder, ledger, deliver, most_files=2))
    reports.append(ordered.drain(spark, folder, ledger, deliver))
    return store, reports


_PARTS = f"(SELECT *, {_REPLAY_PART} AS part FROM {fx.duck('nic_copies')} n)"


@query("k8_ordered_replay", f"SELECT id, rx_bytes, tx_bytes + least(part + 1, 5) AS tx_bytes FROM {_PARTS} a")
def k8_ordered(spark, sf):
    """By name whatever the files' times say, so that the last name's value of an id stays."""
    store, _ = _ordered_replay(spark, sf)
    return lake.read_table(spark, store, "nic_counter").select("id", "rx_bytes", "tx_bytes")


@query(
    "k8_replay_progress",
    f"""SELECT CASE WHEN k < 3 THEN 1 WHEN k < 5 THEN 2 ELSE 3 END AS run, 'mesh.nic_counter.20260625_09000' || CAST(k AS VARCHAR(1)) AS file,
  CAST(COUNT(id) AS BIGINT) AS messages
FROM (SELECT unnest(range(6)) AS k) f LEFT JOIN {_PARTS} p ON p.part = k OR p.part = k - 1 GROUP BY k""",
)
def k8_progress(spark, sf):
    """Which run has sent which file: none behind the failing one, no more than the bound."""
    _, reports = _ordered_replay(spark, sf)
    sent = [(run + 1, name, n) for run, report in enumerate(reports) for name, n in report.sent.items()]
    return spark.createDataFrame(sent, "run int, file string, messages bigint")


@query(
    "t2_stream_upsert",
    f"SELECT id, epoch_ms(fetched_at) AS fetched_at, intf, rx_bytes, tx_bytes FROM {fx.duck('nic_copies')} a",
)
def t2(spark, sf):
    """A redelivered message stream gives every row once."""
    path, store = lake.shared_folder(spark, "buffer"), lake.shared_folder(spark, "lake")
    sent = messages.messages(fx.table(spark, sf, "nic_copies"), "nic_counter", marked_time=True)
    buffer_sink.write_buffer(sent, path)
    buffer_sink.write_buffer(sent.repartition(2), path)
    stream = buffer_source.stream_buffer(spark, path, files_per_batch=1)
    replay.replay(stream, store, f"{store}/_checkpoint").awaitTermination()
    return in_ms(lake.read_table(spark, store, "nic_counter")).drop("snapshot_id")


@query(
    "t2_watermark",
    f"""SELECT id, CAST(SUM(versions) AS BIGINT) AS versions, CAST(MAX(tx) AS BIGINT) AS tx_bytes FROM (
  SELECT id, 1 AS versions, tx_bytes AS tx FROM {fx.duck('nic_copies')} a
  UNION ALL SELECT id, 1, tx_bytes + 1 FROM {fx.duck('nic_copies')} b WHERE rx_bytes % 3000 = 0) x GROUP BY id""",
)
def t2_watermark(spark, sf):
    """Redelivery within the bound never reaches the lake, a changed row does; the reader gives the last one."""
    path, store = lake.shared_folder(spark, "buffer"), lake.shared_folder(spark, "lake")
    rows = fx.table(spark, sf, "nic_copies")
    sent = messages.messages(rows, "nic_counter", marked_time=True)
    for part in (sent, sent.repartition(2), _changed(rows.where("rx_bytes % 3000 = 0"))):
        buffer_sink.write_buffer(part, path)
        stream = buffer_source.stream_buffer(spark, path)
        replay.replay(stream, store, f"{store}/_checkpoint", within="1 hour").awaitTermination()
    kept = lake.versions(spark, store, "nic_counter").groupBy("id").agg(F.count("*").alias("versions"))
    newest = lake.read_table(spark, store, "nic_counter").select("id", "tx_bytes")
    return kept.join(newest, "id")


def _drain(spark, path: str, store: str, name: str = "a") -> None:
    stream = buffer_source.stream_buffer(spark, path)
    replay.replay(stream, store, f"{store}/_checkpoint_{name}").awaitTermination()


def _changed(rows: DataFrame) -> DataFrame:
    return messages.messages(
        rows.withColumn("tx_bytes", F.col("tx_bytes") + 1), "nic_counter", marked_time=True
    )


@query("k3_lake_upsert", f"SELECT id, intf, rx_bytes, tx_bytes + 1 AS tx_bytes FROM {fx.duck('nic_copies')} a")
def k3_lake(spark, sf):
    """Every row delivered again with another value: the last arrival is what the lake holds."""
    path, store = lake.shared_folder(spark, "buffer"), lake.shared_folder(spark, "lake")
    rows = fx.table(spark, sf, "nic_copies")
    buffer_sink.write_buffer(messages.messages(rows, "nic_counter", marked_time=True), path)
    _drain(spark, path, store)
    buffer_sink.write_buffer(_changed(rows), path)
    _drain(spark, path, store)
    return lake.read_table(spark, store, "nic_counter").select("id", "intf", "rx_bytes", "tx_bytes")


@query(
    "k4_two_writers",
    f"""SELECT id, tx_bytes FROM {fx.duck('nic_copies')} a
UNION ALL SELECT id || '-b', tx_bytes + 1 FROM {fx.duck('nic_copies')} b""",
)
def k4_writers(spark, sf):
    """Two replays with checkpoints of their own into one lake."""
    store = lake.shared_folder(spark, "lake")
    rows = fx.table(spark, sf, "nic_copies")
    for name, sent in (
        ("a", messages.messages(rows, "nic_counter", marked_time=True)),
        ("b", _changed(rows.withColumn("id", F.concat("id", F.lit("-b"))))),
    ):
        path = lake.shared_folder(spark, "buffer")
        buffer_sink.write_buffer(sent, path)
        _drain(spark, path, store, name)
    return lake.read_table(spark, store, "nic_counter").select("id", "tx_bytes")


@query(
    "s8_read_table",
    f"""SELECT id, epoch_ms(fetched_at) AS fetched_at, rx_bytes FROM {fx.duck('nic_copies')} a
WHERE epoch_ms(fetched_at) BETWEEN {FROM_MS} AND {TO_MS}""",
)
def s8_window(spark, sf):
    """The days of a window, from a table that holds every row twice."""
    path, store = lake.shared_folder(spark, "buffer"), lake.shared_folder(spark, "lake")
    sent = messages.messages(fx.table(spark, sf, "nic_copies"), "nic_counter", marked_time=True)
    for _ in range(2):
        buffer_sink.write_buffer(sent, path)
        _drain(spark, path, store)
    rows = lake.read_table(spark, store, "nic_counter", FROM_MS, TO_MS).where(
        in_window(F.col("fetched_at"), FROM_MS, TO_MS)
    )
    return in_ms(rows.select("id", "fetched_at", "rx_bytes"))


@query("k3_retry_order", f"SELECT id, rx_bytes, tx_bytes + 1 AS tx_bytes FROM {fx.duck('nic_copies')} a")
def k3_retry(spark, sf):
    """A writer's batch is run again after another writer has stored newer versions: those stay."""
    store = lake.shared_folder(spark, "lake")
    rows = conform(fx.table(spark, sf, "nic_copies"), "nic_counter")
    lake.store_rows(rows, store, "nic_counter", "a")
    lake.store_rows(rows.withColumn("tx_bytes", F.col("tx_bytes") + 1), store, "nic_counter", "b")
    lake.store_rows(rows, store, "nic_counter", "a")
    return lake.read_table(spark, store, "nic_counter").select("id", "rx_bytes", "tx_bytes")


def counters_lake(spark, sf) -> str:
    """Counter tables landed by two writers, a third of the rows twice, and a day of each compacted."""
    store = lake.shared_folder(spark, "lake")
    for table in ("nic_counter", "radio_stats"):
        rows = conform(fx.table(spark, sf, table), table)
        part = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3))
        lake.store_rows(rows.where(part != 0), store, table, "a")
        lake.store_rows(rows.where(part != 1), store, table, "b")
        lake.compact(spark, store, table, "2024-01-09")
    return store


IN_WINDOW = views.Span(from_ms=FROM_MS, to_ms=TO_MS)


@query("f3_stored_radio_rates", over(V1, "*", WINDOW))
def f3_stored_radio(spark, sf):
    """A window over stored tables: its days and the index of last rows, no other day."""
    return in_ms(stored.radio_rates(spark, counters_lake(spark, sf), IN_WINDOW))


@query("f3_stored_wifi_vs_wired", over(V3, "*", WINDOW))
def f3_stored_wifi(spark, sf):
    return in_ms(stored.wifi_vs_wired(spark, counters_lake(spark, sf), IN_WINDOW))


@query("f3_stored_node_wifi", over(V4, "*", WINDOW))
def f3_stored_node(spark, sf):
    return in_ms(stored.node_wifi_rates(spark, counters_lake(spark, sf), IN_WINDOW))


@query("f3_stored_nic_rates", over(V5, "*", WINDOW))
def f3_stored_nic(spark, sf):
    return in_ms(stored.nic_rates(spark, counters_lake(spark, sf), IN_WINDOW))


@query("j1_balanced_ranges", f"SELECT id, t AS t_ms, prev_ms, rx AS rx_bytes, prev_rx AS prev_rx_bytes, prev_tx AS prev_tx_bytes FROM ({PAIRS}) p")
def j1_ranges(spark, sf):
    """The pairs of j2 with busy stretches of an entity cut into ranges of about 100 rows."""
    rows = fx.table(spark, sf, "nic_copies").selectExpr(
        "id", "intf", "unix_millis(fetched_at) AS t_ms", "rx_bytes", "tx_bytes"
    )
    found = with_predecessor(rows, ["intf"], ["rx_bytes", "tx_bytes"], chunk_ms=30 * 86_400_000, most_rows=100)
    return found.select("id", "t_ms", "prev_ms", "rx_bytes", "prev_rx_bytes", "prev_tx_bytes")


@query(
    "k6_landed_columns",
    f"""SELECT id, rx_bytes, CASE WHEN rx_bytes % 3000 = 0 THEN CAST(rx_bytes // 1000 AS BIGINT) END AS mtu FROM {fx.duck('nic_copies')} a""",
)
def k6_landed(spark, sf):
    """A third of the messages carry a field that the table does not declare."""
    path, store = lake.shared_folder(spark, "buffer"), lake.shared_folder(spark, "lake")
    rows = fx.table(spark, sf, "nic_copies")
    sent = messages.messages(rows, "nic_counter", marked_time=True)
    number = F.get_json_object("value", "$.rx_bytes").cast("bigint")
    longer = F.concat(F.expr("left(value, length(value) - 1)"), F.lit(', "mtu": '), F.expr("CAST(get_json_object(value, '$.rx_bytes') AS BIGINT) div 1000"), F.lit("}"))
    sent = sent.withColumn("value", F.when(number % 3000 == 0, longer).otherwise(F.col("value")))
    buffer_sink.write_buffer(sent, path)
    _drain(spark, path, store)
    stored = lake.read_table(spark, store, "nic_counter", added={"mtu": "bigint"})
    return stored.select("id", "rx_bytes", "mtu")


NIC_SERIES = rates.Series(("intf",), ("rx_bytes", "tx_bytes"))


NIC_COPIES = rates.Series(("intf",), ("rx_bytes", "tx_bytes"), row_id="id")


def _streamed_nic(spark, sf, parts: int, order: str, table: str = "nic_counter", series: rates.Series = NIC_SERIES) -> DataFrame:
    """Rates from a stream of ``parts`` files cut along ``order``."""
    folder, landing = lake.shared_folder(spark, "rates"), lake.shared_folder(spark, "series")
    rows = fx.table(spark, sf, table).selectExpr(
        "intf", *series.ids, "unix_millis(fetched_at) AS t_ms", "rx_bytes", "tx_bytes"
    )
    cut = rows.withColumn("part", F.expr(f"pmod({order}, {parts})"))
    for k in range(parts):  # each part lands as files of its own and is drained
        cut.where(F.col("part") == k).drop("part").write.mode("append").parquet(landing)
        stream = spark.readStream.schema(series.ddl()).parquet(landing)
        rates.stream_links(stream, series, folder, f"{folder}/_checkpoint").awaitTermination()
    links = rates.current_links(spark, series, folder)
    return links.where("rx_bytes >= prev_rx_bytes AND tx_bytes >= prev_tx_bytes").selectExpr(
        "t_ms", "intf", "rx_bytes - prev_rx_bytes AS d_rx_bytes",
        "tx_bytes - prev_tx_bytes AS d_tx_bytes", "(t_ms - prev_ms) / 1e3 AS elapsed_secs",
    )


_LINKS = over(V5, "t_ms, intf, d_rx_bytes, d_tx_bytes, elapsed_secs")


@query("t4_stream_rates", _LINKS)
def t4(spark, sf):
    """In order: one file per ten days."""
    return _streamed_nic(spark, sf, 3, "t_ms div 864000000")


@query("t5_late_rows", _LINKS)
def t5(spark, sf):
    """Late: every file holds rows between those of the files before it."""
    return _streamed_nic(spark, sf, 3, "t_ms div 3600000")


@query("t4_stream_rates_copies", _V5_COPIES)
def t4_copies(spark, sf):
    """Several rows of an interface at one time, in order."""
    return _streamed_nic(spark, sf, 3, "t_ms div 864000000", "nic_copies", NIC_COPIES)


@query("t5_late_rows_copies", _V5_COPIES)
def t5_copies(spark, sf):
    """Rows of one time come in different files."""
    return _streamed_nic(spark, sf, 3, "rx_bytes div 1000", "nic_copies", NIC_COPIES)


def _captured(spark, sf, batches: list[DataFrame], payloads: DataFrame | None = None) -> str:
    """Batches of dumps taken in one after the other; the lake's folder."""
    store = lake.shared_folder(spark, "lake")
    for number, dumps in enumerate(batches):
        stream_capture.capture_batch(dumps, number, store, payloads=payloads, writer="checks")
    return store


_MASTER_ROWS = f"""SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, {dm.ROWS['nic_counter']['rx_bytes']} AS rx_bytes, {dm.ROWS['nic_counter']['intf']} AS intf
FROM (SELECT doc_id AS d, n_chars AS n, unnest(range(1 + doc_id % 5)) AS i FROM documents) x"""


@query("t1_redelivered_dump", _MASTER_ROWS)
def t1_redelivered(spark, sf):
    """Every dump delivered twice in a batch, and once more in the next one."""
    dumps = dm.master_dumps(spark, sf)
    store = _captured(spark, sf, [dumps.union(dumps), dumps])
    return lake.read_table(spark, store, "nic_counter").select("snapshot_id", "rx_bytes", "intf")


@query(
    "t1_late_master",
    f"""SELECT snapshot_id, mac AS source_node_mac, CAST(sum(k) AS BIGINT) AS radios FROM (
  SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, 1 + d % 5 AS k,
    CASE WHEN i = 0 OR d % 5 >= 1 THEN {dm.NODE_MAC} END AS mac
  FROM (SELECT doc_id AS d, unnest(range(2)) AS i FROM documents) x) y GROUP BY 1, 2""",
)
def t1_late(spark, sf):
    """Satellites land one batch before their masters."""
    store = _captured(spark, sf, [dm.satellite_dumps(spark, sf), dm.master_dumps(spark, sf)])
    rows = lake.read_table(spark, store, "radio_stats")
    return rows.groupBy("snapshot_id", "source_node_mac").agg(F.count("*").alias("radios"))


@query(
    "t1_names",
    f"""SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, {dm.UUID} AS uuid, CASE WHEN i = 0 THEN 'Full name ' || CAST(d AS VARCHAR(20)) END AS friendly_name
FROM (SELECT doc_id AS d, unnest(range(1 + doc_id % 5)) AS i FROM documents) x""",
)
def t1_names(spark, sf):
    raw = fx.source(spark, sf, "documents").selectExpr("doc_id AS d", "0 AS i").selectExpr(
        "concat('doc', d) AS snapshot_id",
        "to_json(named_struct('result', 'OK', 'output', named_struct('devices', array(named_struct("
        f"'deviceID', {dm.UUID}, 'friendlyName', concat('Full name ', d)))))) AS payload",
    )
    store = _captured(spark, sf, [dm.master_dumps(spark, sf)], name_source.parse_payloads(raw))
    return lake.read_table(spark, store, "device").select("snapshot_id", "uuid", "friendly_name")


@query(
    "t1_stream_capture",
    f"""SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id, (1959822461 + d * 600) * 1000 AS fetched_at, {dm.ROWS['nic_counter']['rx_bytes']} AS rx_bytes,
  {dm.ROWS['nic_counter']['intf']} AS intf
FROM (SELECT doc_id AS d, n_chars AS n, unnest(range(1 + doc_id % 5)) AS i FROM documents) x""",
)
def t1(spark, sf):
    """Dumps as a stream of files, captured into the tables."""
    landing, store = lake.shared_folder(spark, "dumps"), lake.shared_folder(spark, "lake")
    dm.master_dumps(spark, sf).write.parquet(landing)
    dumps = spark.readStream.schema(
        "snapshot_id string, fetched_at timestamp, source_ip string, text string"
    ).option("maxFilesPerTrigger", 4).parquet(landing)
    stream_capture.stream_capture(dumps, store, f"{store}/_checkpoint").awaitTermination()
    rows = lake.read_table(spark, store, "nic_counter")
    return in_ms(rows.select("snapshot_id", "fetched_at", "rx_bytes", "intf"))
