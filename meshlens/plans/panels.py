"""The twenty panel queries: flat selects over the views and tables for one time window.

``from_ms`` and ``to_ms`` are inclusive epoch milliseconds; None leaves a side open. Rows are
sorted for presentation; a caller that stores or joins the result can drop the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.functions.measures import in_window
from meshlens.plans import views
from meshlens.plans.views import Span


def _panel(view: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    named = view.withColumnRenamed("fetched_at", "time")
    return named.select(*columns).orderBy(*order)


def _span(from_ms: int | None, to_ms: int | None) -> Span:
    return Span(from_ms=from_ms, to_ms=to_ms)


def _radio(columns: list[str]):
    def query(
        radio_stats: DataFrame,
        from_ms: int | None = None,
        to_ms: int | None = None,
    ) -> DataFrame:
        view = views.radio_rates(radio_stats, _span(from_ms, to_ms))
        return _panel(view, ["time", "metric", *columns], ["time"])

    return query


def _neighbors(columns: list[str], order: list[str]):
    def query(
        ip_neighbor: DataFrame, from_ms: int | None = None, to_ms: int | None = None
    ) -> DataFrame:
        view = views.neighbor_counts(ip_neighbor, _span(from_ms, to_ms))
        return _panel(view, ["time", "subnet", *columns], order)

    return query


def _node_wifi(columns: list[str]):
    def query(
        radio_stats: DataFrame,
        from_ms: int | None = None,
        to_ms: int | None = None,
    ) -> DataFrame:
        view = views.node_wifi_rates(radio_stats, _span(from_ms, to_ms))
        return _panel(view, ["time", "node", *columns], ["time", "node"])

    return query


q1_tx_rate = _radio(["tx_mbps"])
q2_rx_rate = _radio(["rx_mbps"])
q3_tx_failures = _radio(["tx_fail_pct"])
q4_link_quality = _radio(
    ["rx_rssi", "noise_floor_dbm", "snr_db_approx", "self_bss_util", "obss_util"]
)
q5_live_hosts = _neighbors(["live_hosts"], ["time"])
q6_reachable = _neighbors(["reachable"], ["time"])
q7_unresolved = _neighbors(["unresolved"], ["time"])
q8_neighbor_counts = _neighbors(
    ["live_hosts", "reachable", "stale", "probing", "unresolved"], ["time", "subnet"]
)
q12_node_wifi = _node_wifi(["wifi_mbps"])
q13_node_tx = _node_wifi(["tx_mbps"])
q14_node_rx = _node_wifi(["rx_mbps"])


def latest_at(table: DataFrame, to_ms: int | None = None) -> Column:
    """Test for the rows of the newest snapshot of a table up to ``to_ms``.

    The newest time is a scalar subquery, so the scan of the outer query can prune with it.
    """
    newest = (
        table.where(in_window(F.col("fetched_at"), None, to_ms))
        .agg(F.date_trunc("millisecond", F.max("fetched_at")).alias("newest"))
        .scalar()
    )
    at = F.col("fetched_at")
    return (at >= newest) & (at < newest + F.expr("INTERVAL 1 MILLISECOND"))


def latest_rows(table: DataFrame, to_ms: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the newest snapshot up to ``to_ms``, of every site that ``by`` tells apart its own."""
    if not by:
        return table.where(latest_at(table, to_ms))
    at = F.date_trunc("millisecond", "fetched_at")
    known = table.where(in_window(F.col("fetched_at"), None, to_ms))
    newest = known.groupBy(*by).agg(F.max(at).alias("_newest"))
    return known.join(newest, list(by)).where(at == F.col("_newest")).drop("_newest")


def q9_latest_neighbors(
    ip_neighbor: DataFrame, to_ms: int | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Resolved IPv4 neighbours of the newest snapshot (newest of the whole table, or of each site)."""
    return (
        latest_rows(ip_neighbor, to_ms, by)
        .where((F.col("family") == views.IPV4) & F.col("mac").isNotNull())
        .select(*by, "ip", views.subnet_of().alias("subnet"), "mac", "mac_vendor", "is_router", "state")
        .orderBy(*by, "subnet", "ip")
    )


def q10_wifi_vs_wired(
    nic_counter: DataFrame,
    radio_stats: DataFrame,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    view = views.wifi_vs_wired(nic_counter, radio_stats, _span(from_ms, to_ms))
    return _panel(view, ["time", "category", "mbps"], ["time", "category"])


def q11_wifi_vs_wired_all(nic_counter: DataFrame, radio_stats: DataFrame) -> DataFrame:
    view = views.wifi_vs_wired(nic_counter, radio_stats)
    return view.orderBy("t_ms", "category").select("fetched_at", "category", "mbps")


def q15_node_wifi_all(radio_stats: DataFrame) -> DataFrame:
    view = views.node_wifi_rates(radio_stats)
    return view.orderBy("t_ms", "node").select("fetched_at", "node", "wifi_mbps")


def q16_nic_rates(
    nic_counter: DataFrame,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    view = views.nic_rates(nic_counter, _span(from_ms, to_ms))
    return _panel(view, ["time", "intf", "rx_mbps", "tx_mbps"], ["time"])


def q17_nic_deltas(nic_counter: DataFrame) -> DataFrame:
    return views.nic_rates(nic_counter).select(
        "fetched_at", "intf", "d_rx_bytes", "d_tx_bytes", "elapsed_secs", "rx_mbps", "tx_mbps"
    ).orderBy("intf", "fetched_at")


def display_name() -> Column:
    """First of full name, short name, vendor and address that is there."""
    return F.coalesce(
        F.nullif("friendly_name", F.lit("")), F.nullif("name", F.lit("")), "mac_vendor", "mac"
    )


def _linked_devices(
    device: DataFrame, wlan_client: DataFrame, how: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """Devices with the wireless link of the same snapshot and, ignoring case, address."""
    hosts = device.select(
        *by,
        "snapshot_id",
        F.lower("mac").alias("_mac"),
        F.col("fetched_at").alias("time"),
        display_name().alias("name"),
        "ip",
    )
    links = wlan_client.select(
        *by, "snapshot_id", F.lower("client_mac").alias("_mac"), "mcs", "rssi"
    )
    return hosts.join(links, [*by, "snapshot_id", "_mac"], how)


def q18_device_links(
    device: DataFrame,
    wlan_client: DataFrame,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    """Every device of the window with its wireless link, NULL without one.

    All rows of a snapshot share one capture time, so the window holds for both tables.
    """
    window = in_window(F.col("fetched_at"), from_ms, to_ms)
    joined = _linked_devices(device.where(window), wlan_client.where(window), "left")
    return joined.select("time", "name", "ip", "mcs", "rssi").orderBy("time", "name")


def q19_device_rssi(
    device: DataFrame,
    wlan_client: DataFrame,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    """Signal strength per device over time."""
    window = in_window(F.col("fetched_at"), from_ms, to_ms)
    heard = wlan_client.where(window & F.col("rssi").isNotNull())
    joined = _linked_devices(device.where(window), heard, "inner")
    return joined.select("time", "name", "rssi").orderBy("time")


def q20_latest_device_links(
    device: DataFrame, wlan_client: DataFrame, to_ms: int | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Devices of the newest snapshot (of each site) with their wireless links."""
    if by:  # a snapshot is one site's, so its id alone finds the links
        joined = _linked_devices(latest_rows(device, to_ms, by), wlan_client, "left", by)
    else:
        newest = latest_at(device, to_ms)
        joined = _linked_devices(device.where(newest), wlan_client.where(newest), "left")
    return joined.select(*by, "name", "ip", "mcs", "rssi").orderBy(*by, "name")
