import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meshlens.operators.predecessor import clip_history, with_predecessor
from meshlens.plans import panels, views

SCHEMA = "id int, e1 string, e2 string, t_ms bigint, a bigint, b bigint"


def series(seed, n, copies):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        # One entity holds a third of all rows.
        e1 = "hot" if rng.random() < 0.33 else rng.choice(["x", "y", None])
        t = rng.choice([None, rng.randrange(60), rng.randrange(10**6)]) if copies else k * 997
        rows.append((k, e1, rng.choice(["p", "q"]), t, rng.randrange(100), rng.choice([None, k])))
    rng.shuffle(rows)
    return rows


def brute(rows):
    """Every row with every row of its entity at the latest earlier time."""
    pairs = Counter()
    for c in rows:
        if None in c[1:4]:
            continue
        own = [p for p in rows if p[1:3] == c[1:3] and p[3] is not None and p[3] < c[3]]
        last = max((p[3] for p in own), default=None)
        for p in own:
            if p[3] == last:
                pairs[(c[0], c[3], last, p[4], p[5])] += 1
    return pairs


def linked(df):
    rows = df.select("id", "t_ms", "prev_ms", "prev_a", "prev_b").collect()
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("chunk", [1, 5000, 10**12])
def test_predecessor_of_unique_times(spark, chunk):
    rows = series(1, 300, copies=False)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = with_predecessor(df, ["e1", "e2"], ["a", "b"], chunk_ms=chunk)
    assert linked(got) == brute(rows)
    assert set(got.columns) == {*df.columns, "prev_ms", "prev_a", "prev_b"}


@pytest.mark.parametrize("chunk", [7, 10**12])
def test_predecessor_with_copies(spark, chunk):
    rows = series(2, 250, copies=True)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    pairs = with_predecessor(df, ["e1", "e2"], ["a", "b"], chunk_ms=chunk)
    assert linked(pairs) == want


@pytest.mark.parametrize("copies", [False, True])
def test_clipped_history_gives_the_same_window(spark, copies):
    rows = series(3, 300, copies)
    df = spark.createDataFrame(rows, SCHEMA)
    low, high = (20, 500_000) if copies else (100_000, 200_000)
    whole = with_predecessor(df, ["e1", "e2"], ["a", "b"]).where(F.col("t_ms").between(low, high))
    clipped = clip_history(df, ["e1", "e2"], ["a", "b"], low, high)
    part = with_predecessor(clipped, ["e1", "e2"], ["a", "b"]).where(F.col("t_ms") >= low)
    assert linked(part) == linked(whole) != Counter()


def test_hot_entity_is_split_and_the_exchange_reused(spark, tmp_path):
    df = spark.createDataFrame(series(4, 50, copies=False), SCHEMA)
    df.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    linked = with_predecessor(stored, ["e1", "e2"], ["a", "b"])
    linked.collect()
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
    assert "hashpartitioning(e1" in plan and "_chunk" in plan


def at(minutes):
    return dt.datetime(2026, 6, 1) + dt.timedelta(minutes=minutes)


def nic(spark, rows):
    return spark.createDataFrame(
        [(str(k), "s", at(m), i, rx, tx) for k, (m, i, rx, tx) in enumerate(rows)],
        "id string, snapshot_id string, fetched_at timestamp, intf string, rx_bytes bigint, tx_bytes bigint",
    )


def test_nic_rates_drop_resets_and_first_rows(spark):
    table = nic(spark, [(0, "eth0", 0, 0), (10, "eth0", 75_000_000, 0), (20, "eth0", 10, 10),
                        (40, "eth0", 150_000_010, 10), (0, None, 1, 1), (10, None, 2, 2)])
    got = [(r.t_ms % 3_600_000 // 60_000, r.d_rx_bytes, r.elapsed_secs, r.rx_mbps, r.tx_mbps)
           for r in views.nic_rates(table).orderBy("t_ms").collect()]
    assert got == [(10, 75_000_000, 600.0, 1.0, 0.0), (40, 150_000_000, 1200.0, 1.0, 0.0)]


def radio(spark, rows):
    return spark.createDataFrame(
        [(at(m), mac, name, band, r, stats) for m, mac, name, band, r, stats in rows],
        "fetched_at timestamp, source_node_mac string, source_node_name string, band string, radio string, stats string",
    )


def test_radio_views(spark):
    s = '{"tx_data_bytes": %s, "rx_data_bytes": %s, "tx_data_packets": %s, "tx_failures": %s, "rx_rssi": 30, "lithium_cycle_cnt_chan_nf_bdf_averaged_nf_dbm": -95}'
    table = radio(spark, [
        (0, "m", "Hall", "5G", "wifi0", s % (0, 75_000_000, 10, 0)),
        (10, "m", "Hall", "5G", "wifi0", s % (75_000_000, 0, 30, 1)),  # rx fell: kept by V1, not by V4
        (0, None, None, None, "wifi1", s % (0, 0, 0, 0)),
        (10, None, None, None, "wifi1", s % (75_000_000, 75_000_000, 0, 0)),  # no band: not in V1
        (20, "m", "Hall", "5G", "wifi0", s % ('"<DISABLED>"', 75_000_000, 30, 1)),
    ])
    (v1,) = views.radio_rates(table).collect()
    assert v1.metric == "Hall 5G / wifi0" and v1.tx_mbps == 1.0 and v1.rx_mbps == -1.0
    assert v1.tx_fail_pct == 5.0 and v1.snr_db_approx == -65
    v4 = views.node_wifi_rates(table).collect()
    assert [(r.node, r.wifi_mbps, r.tx_mbps, r.rx_mbps) for r in v4] == [("Router", 2.0, 1.0, 1.0)]
    none = nic(spark, [])
    v3 = views.wifi_vs_wired(none, table).orderBy("t_ms").collect()
    # Both directions added: wifi0 stays at 75,000,000 throughout, wifi1 moves 150,000,000.
    assert [(r.category, r.mbps) for r in v3] == [("WiFi", 2.0), ("WiFi", 0.0)]


def test_neighbor_counts(spark):
    rows = [("inet", "eth0", "a", "REACHABLE"), ("inet", "eth1", "a", "DELAY"), ("inet", "eth1", None, "FAILED"),
            ("inet", None, None, "REACHABLE"), ("inet", "eth9", "A", "PROBE"), ("inet6", "br0", "b", "STALE")]
    table = spark.createDataFrame([(at(0), *r) for r in rows],
                                  "fetched_at timestamp, family string, iface string, mac string, state string")
    got = {r.subnet: (r.live_hosts, r.reachable, r.stale, r.probing, r.unresolved)
           for r in views.neighbor_counts(table).collect()}
    assert got == {"WAN": (1, 1, 0, 1, 1), None: (0, 1, 0, 0, 1), "eth9": (1, 0, 0, 1, 0)}


def test_latest_snapshot_is_the_newest_of_the_whole_table(spark):
    rows = [(at(0), "inet", "br0", "a"), (at(10), "inet6", "br0", "b")]
    table = spark.createDataFrame(
        rows, "fetched_at timestamp, family string, iface string, mac string"
    ).selectExpr("*", "'1' AS ip", "'v' AS mac_vendor", "false AS is_router", "'STALE' AS state")
    assert panels.q9_latest_neighbors(table).count() == 0
    first = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert panels.q9_latest_neighbors(table, first).count() == 1
    assert panels.q9_latest_neighbors(table, first - 1).count() == 0


def test_device_links(spark):
    device = spark.createDataFrame(
        [("s", at(0), "AA", "", "", "Acme", "1"), ("s", at(0), "BB", "Full", "short", None, "2"),
         ("s", at(0), None, None, None, None, "3")],
        "snapshot_id string, fetched_at timestamp, mac string, friendly_name string, name string, mac_vendor string, ip string",
    )
    wlan = spark.createDataFrame(
        [("s", at(0), "aa", "RSN", -60), ("s", at(0), "Aa", "211", None), ("t", at(0), "bb", "1", -50)],
        "snapshot_id string, fetched_at timestamp, client_mac string, mcs string, rssi int",
    )
    got = Counter((r.name, r.ip, r.mcs, r.rssi) for r in panels.q18_device_links(device, wlan).collect())
    assert got == Counter([("Acme", "1", "RSN", -60), ("Acme", "1", "211", None), ("Full", "2", None, None), (None, "3", None, None)])
    assert [(r.name, r.rssi) for r in panels.q19_device_rssi(device, wlan).collect()] == [("Acme", -60)]


def test_window_reaches_the_scan(spark, tmp_path):
    nic(spark, [(m, "eth0", m, m) for m in range(5)]).write.parquet(str(tmp_path / "n"))
    table = spark.read.parquet(str(tmp_path / "n"))
    table = table.selectExpr("fetched_at", "'inet' AS family", "intf AS iface", "id AS mac", "'STALE' AS state")
    plan = panels.q5_live_hosts(table, 0, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(fetched_at" in plan and "LessThan(fetched_at" in plan


def test_rate_window_reaches_both_scans(spark, tmp_path):
    nic(spark, [(m, "eth0", m, m) for m in range(5)]).write.parquet(str(tmp_path / "n"))
    table = spark.read.parquet(str(tmp_path / "n"))
    low = int(at(2).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = panels.q16_nic_rates(table, low, low + 60_000)
    assert [r.time for r in got.collect()] == [at(2), at(3)]
    plan = panels.q16_nic_rates(table, low, low + 60_000)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("LessThan(fetched_at" in line for line in scans)
    assert any("GreaterThanOrEqual(fetched_at" in line for line in scans)


@pytest.mark.parametrize("most_rows", [None, 20])
def test_rows_of_one_time_meet_in_small_blocks(spark, monkeypatch, most_rows):
    monkeypatch.setattr("meshlens.operators.predecessor.BLOCK", 4)
    rows = series(5, 250, copies=True)
    df = spark.createDataFrame(rows, SCHEMA)
    got = with_predecessor(df, ["e1", "e2"], ["a", "b"], chunk_ms=10**5, most_rows=most_rows)
    assert linked(got) == brute(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "collect_list" in line and "_cut" not in line]
    assert grouped and all("_block" in line for line in grouped)  # no time is gathered as a whole


def test_time_before_without_pairs(spark):
    rows = series(6, 250, copies=True)
    got = with_predecessor(spark.createDataFrame(rows, SCHEMA), ["e1", "e2"], ["a", "b"], paired=False)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = Counter((r.id, r.t_ms, r.prev_ms) for r in got.collect())
    assert found == Counter({k[:3]: 1 for k in brute(rows)})
