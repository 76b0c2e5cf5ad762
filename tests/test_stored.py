"""Stored index of last rows, arrival order, and ranges of busy series."""

import datetime as dt

from pyspark.sql import functions as F

from meshlens.operators.predecessor import SLICES, in_ranges, with_predecessor
from meshlens.plans import stored, views
from meshlens.sinks import lake
from meshlens.sources.tables import conform
from meshlens.streaming import capture as stream_capture

from test_extract import DUMP

DAY = 86_400_000
START = dt.datetime(2032, 2, 1)
START_MS = 1959206400000
NIC = "id string, snapshot_id string, fetched_at timestamp, intf string, rx_bytes bigint, tx_bytes bigint"


def at(day, hour=0):
    return START + dt.timedelta(days=day, hours=hour)


def nic(spark, rows):
    return conform(spark.createDataFrame([(i, "s", t, e, n, n) for i, t, e, n in rows], NIC), "nic_counter")


def found(df):
    return sorted(map(tuple, df.select("t_ms", "intf", "rx_bytes", "d_rx_bytes", "elapsed_secs").collect()), key=repr)


def test_window_reads_no_earlier_day(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = [(f"{e}{d}{h}", at(d, h), e, 10 * d + h) for d in range(6) for h in (1, 13) for e in ("e0", "e1")]
    rows += [("old", at(0, 5), "e2", 1), ("new", at(4, 6), "e2", 9), ("none", at(1), None, 1)]
    rows += [("twin", at(2, 13), "e0", 30)]  # a second row at an entity's last time of a day
    lake.store_rows(nic(spark, rows[::2]), root, "nic_counter", "a")
    lake.store_rows(nic(spark, rows[1::2]), root, "nic_counter", "b")
    lake.store_rows(nic(spark, rows[:3]), root, "nic_counter", "b", 1)
    lake.compact(spark, root, "nic_counter", str(at(1).date()))
    whole = nic(spark, rows)
    for span in (views.Span(START_MS + 3 * DAY, START_MS + 5 * DAY), views.Span(START_MS + 4 * DAY + 7_200_000, None), views.Span(None, START_MS + 2 * DAY)):
        want = found(views.nic_rates(whole, span))
        assert want and found(stored.nic_rates(spark, root, span)) == want
    span = views.Span(START_MS + 3 * DAY, START_MS + 5 * DAY)
    want = found(views.nic_rates(whole, span))
    assert any(r[1] == "e2" and r[4] == (4 * 24 + 1) * 3600 for r in want)
    made = stored.nic_rates(spark, root, span)
    scans = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert all("day#" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    for d in range(3):  # the facts before the window may as well be gone
        lake.remove(spark, f"{root}/nic_counter/day={at(d).date()}")
    assert found(stored.nic_rates(spark, root, span)) == want


def test_redelivered_last_row_counts_in_its_newest_version(spark, tmp_path):
    root = str(tmp_path / "lake")
    lake.store_rows(nic(spark, [("x", at(0), "e0", 1), ("y", at(0, 9), "e0", 5)]), root, "nic_counter", "a")
    lake.store_rows(nic(spark, [("y", at(0, 9), "e0", 7), ("z", at(1), "e0", 9)]), root, "nic_counter", "b")
    lake.store_rows(nic(spark, [("x", at(0), "e0", 1), ("y", at(0, 9), "e0", 5)]), root, "nic_counter", "a")  # again
    got = found(stored.nic_rates(spark, root, views.Span(START_MS + DAY, START_MS + 2 * DAY)))
    assert got == [(START_MS + DAY, "e0", 9, 2, 15 * 3600.0)]


def test_rows_that_move_to_another_entity(spark, tmp_path):
    """Untagged rows of a satellite are the untagged node's until its master lands."""
    root = str(tmp_path / "lake")
    schema = "snapshot_id string, fetched_at timestamp, source_ip string, text string"

    def batch(number, *dumps):
        frame = spark.createDataFrame([(s, t, ip, DUMP) for s, t, ip in dumps], schema)
        stream_capture.capture_batch(frame, number, root, writer="w")

    sat = "10.44.8.6"
    batch(0, ("s1", at(0, 1), sat), ("s2", at(0, 2), sat))
    batch(1, ("s2", at(0, 2), None), ("s3", at(1, 1), None), ("s3", at(1, 1), sat), ("s4", at(1, 2), sat))

    def links(rows):
        keyed = rows.selectExpr("coalesce(source_node_mac, '-') AS node", "radio", "unix_millis(fetched_at) AS t_ms")
        made = with_predecessor(keyed, ["node", "radio"], []).where(f"t_ms >= {START_MS + DAY}")
        return sorted(map(tuple, made.select("node", "radio", "t_ms", "prev_ms").collect()))

    got = links(lake.read_series(spark, root, "radio_stats", START_MS + DAY, START_MS + 2 * DAY))
    assert got == links(lake.read_table(spark, root, "radio_stats"))
    hour = 3_600_000
    gaps = sorted((t - START_MS - DAY, t - prev) for _, radio, t, prev in got if radio == "wifi0")
    assert gaps == [(hour, DAY - hour), (hour, DAY - hour), (2 * hour, DAY + hour)]


def test_arrival_numbers_grow_and_stay(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    first = lake.arrival_number(spark, root, "t", "a", 0)
    monkeypatch.setattr(lake.time, "time_ns", lambda: 0)  # the clock has gone back
    second = lake.arrival_number(spark, root, "t", "a", 1)
    assert second == first + 1
    assert lake.arrival_number(spark, root, "t", "a", 0) == first
    assert lake.arrival_number(spark, root, "t", "b", 0) == 0


def test_days_in_one_batch_are_read_as_they_are(spark, tmp_path):
    root = str(tmp_path / "lake")
    lake.store_rows(nic(spark, [("x", at(0), "e0", 1), ("y", at(1), "e0", 5)]), root, "nic_counter", "a")
    lake.store_rows(nic(spark, [("x", at(0), "e0", 2)]), root, "nic_counter", "b")

    def read():
        return lake.read_table(spark, root, "nic_counter", START_MS, START_MS + 2 * DAY)

    def plan():
        return read()._jdf.queryExecution().executedPlan().toString()

    assert {r.id: r.rx_bytes for r in read().collect()} == {"x": 2, "y": 5} and "Aggregate" in plan()
    lake.compact(spark, root, "nic_counter", str(at(0).date()))
    assert {r.id: r.rx_bytes for r in read().collect()} == {"x": 2, "y": 5} and "Aggregate" not in plan()


def test_a_busy_day_of_one_interface_is_many_balanced_ranges(spark):
    n, most = 1_000_000, 50_000
    # Three quarters of the day's rows come within one hour.
    t = F.when(F.col("id") % 4 == 0, F.col("id") * 86_400 % DAY).otherwise(F.col("id") * 3_600 % 3_600_000)
    rows = spark.range(n).select(F.col("id").alias("v"), F.lit("eth0").alias("e"), (t.cast("bigint") + F.lit(START_MS)).alias("t_ms"))
    placed = rows.withColumn("_chunk", F.expr(f"t_ms div {DAY}"))
    cut = in_ranges(placed, ["e", "_chunk"], F.expr(f"pmod(t_ms, {DAY}) * {SLICES} div {DAY}"), most)
    sizes = [r["n"] for r in cut.groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= n // most - 1 and max(sizes) < 2 * most and sum(sizes) == n
    assert cut.groupBy("_range").agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("z")).where("a > z").count() == 0


def test_ranges_give_the_same_links(spark):
    rows = spark.range(3000).selectExpr("id", "CAST(id % 2 AS STRING) AS e", "hash(id) % 5000 AS h", "id * 7 AS v")
    rows = rows.selectExpr("id", "e", f"{START_MS} + abs(h) * 40000 AS t_ms", "v")
    plain = with_predecessor(rows, ["e"], ["v"])
    cut = with_predecessor(rows, ["e"], ["v"], most_rows=20)
    take = lambda df: sorted(map(repr, df.select("id", "t_ms", "prev_ms", "v", "prev_v").collect()))
    assert take(cut) == take(plain) and len(take(cut)) >= 2990


def test_late_masters_tag_rows_kept_aside(spark, tmp_path):
    """No batch reads the stored per-node tables: they may as well be away."""
    root = str(tmp_path / "lake")
    schema = "snapshot_id string, fetched_at timestamp, source_ip string, text string"

    def batch(number, *dumps):
        frame = spark.createDataFrame([(s, at(0, h), ip, DUMP) for s, h, ip in dumps], schema)
        stream_capture.capture_batch(frame, number, root, writer="w")

    sat = "10.44.8.6"
    batch(0, ("s1", 1, sat), ("s2", 2, sat), ("s3", 3, None))
    assert lake.waiting_rows(spark, root, "radio_stats", START_MS, START_MS + DAY).count() == 4
    hidden = tmp_path / "hidden"
    (tmp_path / "lake/radio_stats").rename(hidden)
    batch(1, ("s2", 2, None))
    batch(1, ("s2", 2, None))  # run again
    rows = spark.read.parquet(f"{root}/radio_stats").groupBy("snapshot_id", "source_role").count().collect()
    assert sorted(map(tuple, rows)) == [("s2", "master", 2), ("s2", "slave", 2)]
    lake.drop_waiting(spark, root, at(1).date())
    assert lake.waiting_rows(spark, root, "radio_stats", START_MS, START_MS + DAY).count() == 0


def test_of_two_dumps_of_a_node_the_last_to_arrive_counts(spark, tmp_path):
    root = str(tmp_path / "lake")
    short = DUMP.replace("wifi1", "wifi9")
    schema = "snapshot_id string, fetched_at timestamp, source_ip string, text string, arrival int"
    for number, arrivals in enumerate([(1, 2), (2, 1)]):
        rows = [(f"s{number}", at(number), None, text, n) for text, n in zip((DUMP, short), arrivals)]
        stream_capture.capture_batch(spark.createDataFrame(rows, schema), number, root, writer="w")
    got = lake.read_table(spark, root, "radio_stats").select("fetched_at", "radio").collect()
    assert sorted(map(tuple, got)) == [(at(0), "wifi0"), (at(0), "wifi9"), (at(1), "wifi0"), (at(1), "wifi1")]


def test_a_batch_stores_few_files_a_day(spark, tmp_path):
    rows = nic(spark, [(f"{d}-{k}", at(d), "e0", k) for d in range(3) for k in range(30)]).repartition(10)
    lake.store_rows(rows, str(tmp_path), "nic_counter", "a")
    for day in (tmp_path / "nic_counter").glob("day=*"):
        assert len(list(day.rglob("*.parquet"))) == 1  # and not one a task
    assert lake.read_table(spark, str(tmp_path), "nic_counter").count() == 90
