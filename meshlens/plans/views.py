"""The five views. Each takes the base tables and gives one row per series point.

``from_ms``/``to_ms`` bound the points exactly as a filter on the finished view would, but
below the shuffle: see :func:`meshlens.operators.predecessor.clip_history`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.functions.measures import epoch_ms, in_window, mbps, percent, seconds, whole_number
from meshlens.operators.predecessor import CHUNK_MS, clip_history, with_predecessor

# Counter keys, labels and default keys the views are defined on.
RADIO_COUNTERS = {
    "tx_bytes": "tx_data_bytes",
    "rx_bytes": "rx_data_bytes",
    "tx_pkts": "tx_data_packets",
    "tx_failures": "tx_failures",
}
RADIO_GAUGES = {
    "rx_rssi": "rx_rssi",
    "self_bss_util": "self_bss_chan_util",
    "obss_util": "obss_chan_util",
    "noise_floor_dbm": "lithium_cycle_cnt_chan_nf_bdf_averaged_nf_dbm",
}
SUBNETS = {
    "br0": "Main LAN",
    "br1": "Guest",
    "br2": "Smart Connect",
    "eth0": "WAN",
    "eth1": "WAN",
}
WIRED_PORTS = ("eth0", "eth1")
UNTAGGED_NODE = "master"
UNTAGGED_LABEL = "Router"
IPV4 = "inet"


@dataclass(frozen=True)
class Span:
    """Time bounds (closed, epoch ms) and how finely the predecessor search is cut.

    ``clipped``: of the time before ``from_ms`` the rows hold what is needed and little else, as
    those of :func:`meshlens.sinks.lake.read_series` do. ``most_rows``: an entity's days of more
    rows are cut into ranges of about as many. ``by`` names columns of the tables that tell
    sites (or tenants) apart: series are not linked across them, and results have them in front.
    """

    from_ms: int | None = None
    to_ms: int | None = None
    chunk_ms: int = CHUNK_MS
    clipped: bool = False
    most_rows: int | None = None
    by: tuple[str, ...] = ()


ALL = Span()


def _linked(rows: DataFrame, entity: list[str], figures: list[str], span: Span) -> DataFrame:
    entity = [*span.by, *entity]
    if not span.clipped:
        rows = clip_history(rows, entity, figures, span.from_ms, span.to_ms, at="fetched_at")
    linked = with_predecessor(rows, entity, figures, chunk_ms=span.chunk_ms, most_rows=span.most_rows)
    return linked if span.from_ms is None else linked.where(F.col("t_ms") >= span.from_ms)


def _delta(name: str):
    return F.col(name) - F.col(f"prev_{name}")


def _elapsed():
    return F.col("t_ms") - F.col("prev_ms")


def _radio_points(radio_stats: DataFrame, keys: dict[str, str], label: str, by: tuple[str, ...]) -> DataFrame:
    """Radio rows with the wanted counters read from the stats object in one parse."""
    wanted = ", ".join(f"{k} string" for k in keys.values())
    return (
        radio_stats.select(
            *by,
            F.coalesce("source_node_mac", F.lit(UNTAGGED_NODE)).alias("node"),
            F.coalesce("source_node_name", F.lit(label)).alias("node_name"),
            "band",
            "radio",
            F.col("fetched_at").cast("timestamp").alias("fetched_at"),
            epoch_ms(F.col("fetched_at")).alias("t_ms"),
            F.from_json("stats", wanted).alias("s"),
        )
        .select(
            *by,
            "node",
            "node_name",
            "band",
            "radio",
            "fetched_at",
            "t_ms",
            *(whole_number(F.col(f"s.{k}")).alias(c) for c, k in keys.items()),
        )
    )


def radio_rates(radio_stats: DataFrame, span: Span = ALL) -> DataFrame:
    """V1: throughput and link quality per radio; intervals whose tx counter fell are dropped."""
    figures = [*RADIO_COUNTERS, *RADIO_GAUGES]
    points = _radio_points(radio_stats, RADIO_COUNTERS | RADIO_GAUGES, UNTAGGED_NODE, span.by)
    linked = _linked(points, ["node", "band", "radio"], figures, span)
    return linked.where(_delta("tx_bytes") >= 0).select(
        *span.by,
        "fetched_at",
        "t_ms",
        F.concat("node_name", F.lit(" "), "band", F.lit(" / "), "radio").alias("metric"),
        mbps(_delta("tx_bytes"), _elapsed()).alias("tx_mbps"),
        mbps(_delta("rx_bytes"), _elapsed()).alias("rx_mbps"),
        "rx_rssi",
        "noise_floor_dbm",
        (F.col("rx_rssi") + F.col("noise_floor_dbm")).alias("snr_db_approx"),
        "self_bss_util",
        "obss_util",
        percent(_delta("tx_failures"), _delta("tx_pkts")).alias("tx_fail_pct"),
    )


def subnet_of(iface: str = "iface"):
    """Subnet label of an interface; an unknown interface keeps its name."""
    label = F.col(iface)
    for name, subnet in reversed(SUBNETS.items()):
        label = F.when(F.col(iface) == name, subnet).otherwise(label)
    return label


def neighbor_counts(ip_neighbor: DataFrame, span: Span = ALL) -> DataFrame:
    """V2: IPv4 hosts per snapshot and subnet, by neighbour state."""
    state = F.col("state")
    return (
        ip_neighbor.where(F.col("family") == IPV4)
        .where(in_window(F.col("fetched_at"), span.from_ms, span.to_ms))
        .groupBy(*span.by, "fetched_at", subnet_of().alias("subnet"))
        .agg(
            F.count_distinct("mac").alias("live_hosts"),
            F.count_if(state == "REACHABLE").alias("reachable"),
            F.count_if(state == "STALE").alias("stale"),
            F.count_if(state.isin("DELAY", "PROBE")).alias("probing"),
            F.count_if(F.col("mac").isNull()).alias("unresolved"),
        )
        .select(
            *span.by,
            F.col("fetched_at").cast("timestamp").alias("fetched_at"),
            epoch_ms(F.col("fetched_at")).alias("t_ms"),
            "subnet",
            "live_hosts",
            "reachable",
            "stale",
            "probing",
            "unresolved",
        )
    )


def wifi_vs_wired(nic_counter: DataFrame, radio_stats: DataFrame, span: Span = ALL) -> DataFrame:
    """V3: wired and wireless throughput per snapshot.

    Sent and received bytes are added before the reset test; the longest interval of a
    snapshot is the denominator for all its entities.
    """
    wired = nic_counter.where(F.col("intf").isin(*WIRED_PORTS)).select(
        *span.by,
        "intf",
        F.col("fetched_at").cast("timestamp").alias("fetched_at"),
        epoch_ms(F.col("fetched_at")).alias("t_ms"),
        (F.col("rx_bytes") + F.col("tx_bytes")).alias("bytes"),
    )
    traffic = {c: RADIO_COUNTERS[c] for c in ("tx_bytes", "rx_bytes")}
    zero = F.lit(0).cast("bigint")
    wifi = _radio_points(radio_stats, traffic, UNTAGGED_LABEL, span.by).select(
        *span.by,
        "node",
        "radio",
        "fetched_at",
        "t_ms",
        (F.coalesce("tx_bytes", zero) + F.coalesce("rx_bytes", zero)).alias("bytes"),
    )

    def series(points: DataFrame, entity: list[str], category: str) -> DataFrame:
        linked = _linked(points, entity, ["bytes"], span)
        return (
            linked.where(_delta("bytes") >= 0)
            .groupBy(*span.by, "fetched_at", "t_ms")
            .agg(F.sum(_delta("bytes")).alias("moved"), F.max(_elapsed()).alias("elapsed"))
            .select(
                *span.by,
                "fetched_at",
                "t_ms",
                F.lit(category).alias("category"),
                mbps(F.col("moved"), F.col("elapsed")).alias("mbps"),
            )
        )

    return series(wired, ["intf"], "Wired").unionByName(
        series(wifi, ["node", "radio"], "WiFi")
    )


def node_wifi_rates(radio_stats: DataFrame, span: Span = ALL) -> DataFrame:
    """V4: wireless throughput per node; a radio whose tx or rx counter fell is left out."""
    figures = ["tx_bytes", "rx_bytes"]
    traffic = {c: RADIO_COUNTERS[c] for c in figures}
    points = _radio_points(radio_stats, traffic, UNTAGGED_LABEL, span.by).fillna(0, figures)
    linked = _linked(points.drop("band"), ["node", "radio"], figures, span)
    moved = (
        linked.where((_delta("tx_bytes") >= 0) & (_delta("rx_bytes") >= 0))
        .groupBy(*span.by, "fetched_at", "t_ms", "node", "node_name")
        .agg(
            F.sum(_delta("tx_bytes")).alias("sent"),
            F.sum(_delta("rx_bytes")).alias("received"),
            F.max(_elapsed()).alias("elapsed"),
        )
    )
    elapsed = F.col("elapsed")
    return moved.select(
        *span.by,
        "fetched_at",
        "t_ms",
        F.col("node_name").alias("node"),
        mbps(F.col("sent") + F.col("received"), elapsed).alias("wifi_mbps"),
        mbps(F.col("sent"), elapsed).alias("tx_mbps"),
        mbps(F.col("received"), elapsed).alias("rx_mbps"),
    )


def nic_rates(nic_counter: DataFrame, span: Span = ALL) -> DataFrame:
    """V5: bytes moved and throughput per interface; resets of either counter are dropped."""
    points = nic_counter.select(
        *span.by,
        "intf",
        F.col("fetched_at").cast("timestamp").alias("fetched_at"),
        epoch_ms(F.col("fetched_at")).alias("t_ms"),
        "rx_bytes",
        "tx_bytes",
    )
    linked = _linked(points, ["intf"], ["rx_bytes", "tx_bytes"], span)
    return linked.where((_delta("rx_bytes") >= 0) & (_delta("tx_bytes") >= 0)).select(
        *span.by,
        "fetched_at",
        "t_ms",
        "intf",
        "rx_bytes",
        "tx_bytes",
        _delta("rx_bytes").alias("d_rx_bytes"),
        _delta("tx_bytes").alias("d_tx_bytes"),
        seconds(_elapsed()).alias("elapsed_secs"),
        mbps(_delta("rx_bytes"), _elapsed()).alias("rx_mbps"),
        mbps(_delta("tx_bytes"), _elapsed()).alias("tx_mbps"),
    )
