import datetime as dt
import gzip
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from meshlens.operators.upsert import evolve, latest_by, upsert
from meshlens.plans.capture import capture, capture_to_lake
from meshlens.sinks import buffer as buffer_sink
from meshlens.sinks import messages
from meshlens.sinks.lake import compact, read_batches, read_table, shared_folder, versions
from meshlens.sources import buffer as buffer_source
from meshlens.sources import dumps as dump_source
from meshlens.sources.tables import TABLES
from meshlens.streaming import capture as stream_capture
from meshlens.streaming import rates, replay

from test_extract import DUMP

AT = dt.datetime(2032, 2, 9, 3, 7, 41, 123000)
AT_MS = 1959908861123


def device_rows(spark):
    return spark.createDataFrame(
        [("a", "snap-1", AT, "aa", ["b", None], None), ("b", "snap-1", AT, None, None, [])],
        "id string, snapshot_id string, fetched_at timestamp, mac string, extra_macs array<string>, extra_macs_vendor array<string>",
    )


def test_messages_keep_every_field(spark):
    sent = messages.messages(device_rows(spark), "device").orderBy("value").collect()
    assert {(r.topic, r.key) for r in sent} == {("mesh.device", "snap-1")}
    first = json.loads(sent[0].value)
    assert len(first) == 15 and list(first)[:3] == ["id", "snapshot_id", "fetched_at"]
    assert first["fetched_at"] == AT_MS
    assert first["extra_macs"] == ["b", None] and first["extra_macs_vendor"] is None
    marked = messages.messages(device_rows(spark), "device", "x.", marked_time=True).head()
    assert marked.topic == "x.device"
    assert json.loads(marked.value)["fetched_at"] == {"__dt_ms__": AT_MS}


def test_object_columns_stay_json_text(spark):
    rows = spark.createDataFrame(
        [("1", "s", AT, '{"tx": 42}'), ("2", "s", AT, None)],
        "id string, snapshot_id string, fetched_at timestamp, stats string",
    )
    got = [json.loads(r.value)["stats"] for r in messages.messages(rows, "radio_stats").orderBy("value").collect()]
    assert got == ['{"tx": 42}', None]


def test_parse_gives_back_rows_and_dead_letters(spark):
    rows = device_rows(spark)
    for marked in (False, True):
        sent = messages.messages(rows, "device", marked_time=marked)
        broken = spark.createDataFrame(
            [("mesh.device", "k", "{"), ("mesh.device", "k", '{"id": "x"}'), ("mesh.ping", "k", "{}")],
            "topic string, key string, value string",
        )
        back, dead = messages.parse_messages(sent.unionByName(broken), "device")
        assert [(r.id, r.fetched_at, r.extra_macs) for r in back.orderBy("id").collect()] == [
            ("a", AT, ["b", None]), ("b", AT, None)
        ]
        assert sorted(r.value for r in dead.collect()) == ["{", '{"id": "x"}']


def test_buffer_layouts(spark, tmp_path):
    value = {"id": "a", "snapshot_id": "s", "fetched_at": {"__dt_ms__": AT_MS}, "target": "t"}
    line = json.dumps({"key": "s", "value": value})
    (tmp_path / "mesh.ping.20260625_090807").write_text(line + "\n\n")
    (tmp_path / "mesh.ping.20260625_090807-1").write_text(line.replace('"a"', '"b"') + "\n")
    (tmp_path / "mesh.ping.20260625_090808.part").write_text(line)
    (tmp_path / "mesh.ping.20260625_090809.gz").write_bytes(gzip.compress(line.encode()))
    (tmp_path / "notes.txt").write_text(line)
    sent = messages.messages(
        spark.createDataFrame([("c", "s", AT)], "id string, snapshot_id string, fetched_at timestamp"),
        "ping", marked_time=True,
    )
    buffer_sink.write_buffer(sent, str(tmp_path))
    pending = buffer_source.read_buffer(spark, str(tmp_path))
    assert {(r.topic, r.key) for r in pending.collect()} == {("mesh.ping", "s")}
    back, dead = messages.parse_messages(pending, "ping")
    assert [(r.id, r.fetched_at) for r in back.orderBy("id").collect()] == [("a", AT), ("b", AT), ("c", AT)]
    assert dead.count() == 0


def test_counts_skip_empty_tables(spark):
    rows = device_rows(spark)
    sent = messages.all_messages({"device": rows, "ping": rows.where("false")})
    assert [tuple(r) for r in messages.message_counts(sent).collect()] == [("mesh.device", 2)]


def test_upsert_and_evolution(spark):
    target = spark.createDataFrame([("1", "old"), ("2", "kept")], "id string, v string")
    arrivals = spark.createDataFrame(
        [("1", "newer", 2, None), ("1", "new", 1, None), ("3", "added", 1, 7)], "id string, v string, arrival bigint, extra int"
    )
    got = {r.id: (r.v, r.extra) for r in upsert(target, arrivals).collect()}
    assert got == {"1": ("newer", None), "2": ("kept", None), "3": ("added", 7)}
    assert evolve(target, arrivals).columns == ["id", "v", "arrival", "extra"]
    assert latest_by(arrivals, ["id"], "arrival").count() == 2


def test_replay_stores_every_row_once(spark, tmp_path):
    buffer, lake = str(tmp_path / "buffer"), str(tmp_path / "lake")
    rows = device_rows(spark)
    sent = messages.messages(rows, "device", marked_time=True)
    odd = spark.createDataFrame([("mesh.nothing", "k", "{}"), ("mesh.device", "k", "[")], sent.schema)

    def drain():
        stream = buffer_source.stream_buffer(spark, buffer, files_per_batch=1)
        replay.replay(stream, lake, f"{lake}/_checkpoint").awaitTermination()

    buffer_sink.write_buffer(sent, buffer)
    drain()
    buffer_sink.write_buffer(sent.unionByName(odd), buffer)  # redelivered, with bad records
    more = rows.withColumn("id", F.concat("id", F.lit("2")))
    buffer_sink.write_buffer(messages.messages(more, "device", marked_time=True), buffer)
    drain()
    drain()  # nothing left
    stored = read_table(spark, lake, "device")
    assert sorted(r.id for r in stored.collect()) == ["a", "a2", "b", "b2"]
    dead = read_batches(spark, f"{lake}/{replay.DEAD_LETTERS}", "topic string, key string, value string")
    assert sorted((r.topic, r.value) for r in dead.collect()) == [
        ("mesh.device", '{"key": "k", "value": [}'), ("mesh.nothing", "{}")
    ]


def test_failed_batch_is_run_again(spark, tmp_path, monkeypatch):
    buffer, lake = str(tmp_path / "buffer"), str(tmp_path / "lake")
    buffer_sink.write_buffer(messages.messages(device_rows(spark), "device", marked_time=True), buffer)

    def drain():
        stream = buffer_source.stream_buffer(spark, buffer)
        replay.replay(stream, lake, f"{lake}/_checkpoint").awaitTermination()

    real = replay.store_rows

    def fails_late(*stored):
        real(*stored)
        raise RuntimeError("down")

    monkeypatch.setattr(replay, "store_rows", fails_late)
    with pytest.raises(Exception):  # noqa: B017 - the query fails with the batch
        drain()
    monkeypatch.setattr(replay, "store_rows", real)
    drain()
    assert read_table(spark, lake, "device").count() == 2
    assert versions(spark, lake, "device").count() == 2


def buffered(spark, folder, rows):
    frame = spark.createDataFrame(rows, "id string, snapshot_id string, fetched_at timestamp, intf string, rx_bytes bigint")
    buffer_sink.write_buffer(messages.messages(frame, "nic_counter", marked_time=True), folder)


def test_last_arrival_wins_and_writers_share_a_lake(spark, tmp_path):
    lake = str(tmp_path / "lake")

    def drain(name):
        stream = buffer_source.stream_buffer(spark, str(tmp_path / name))
        replay.replay(stream, lake, str(tmp_path / f"{name}-checkpoint")).awaitTermination()

    buffered(spark, str(tmp_path / "a"), [("u", "s", AT, "e0", 1), ("a", "s", AT, "e0", 5)])
    drain("a")
    buffered(spark, str(tmp_path / "b"), [("b", "s", AT, "e0", 7)])
    drain("b")  # another checkpoint, its batch 0
    buffered(spark, str(tmp_path / "a"), [("u", "s", AT, "e0", 99)])
    drain("a")
    got = {r.id: r.rx_bytes for r in read_table(spark, lake, "nic_counter").collect()}
    assert got == {"u": 99, "a": 5, "b": 7}
    compact(spark, lake, "nic_counter", str(AT.date()))
    assert {r.id: r.rx_bytes for r in read_table(spark, lake, "nic_counter").collect()} == got
    assert versions(spark, lake, "nic_counter").count() == 3


def test_window_prunes_days(spark, tmp_path):
    lake = str(tmp_path / "lake")
    days = [AT + dt.timedelta(days=k) for k in range(4)]
    buffered(spark, str(tmp_path / "a"), [(str(k), "s", d, "e0", k) for k, d in enumerate(days)])
    stream = buffer_source.stream_buffer(spark, str(tmp_path / "a"))
    replay.replay(stream, lake, str(tmp_path / "c")).awaitTermination()
    part = read_table(spark, lake, "nic_counter", AT_MS + 86_400_000, AT_MS + 2 * 86_400_000)
    assert sorted(r.id for r in part.collect()) == ["1", "2"]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PartitionFilters: []" not in plan


def test_added_fields_land(spark, tmp_path):
    lake, folder = str(tmp_path / "lake"), str(tmp_path / "a")
    value = {"id": "x", "snapshot_id": "s", "fetched_at": AT_MS, "intf": "e0", "mtu": 1500, "duplex": "full"}
    line = json.dumps({"key": "s", "value": value})
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "mesh.nic_counter.20320209_030741").write_text(line + "\n")
    buffered(spark, folder, [("old", "s", AT, "e0", 1)])
    stream = buffer_source.stream_buffer(spark, folder)
    replay.replay(stream, lake, str(tmp_path / "c")).awaitTermination()
    rows = read_table(spark, lake, "nic_counter", added={"mtu": "bigint", "duplex": "string"})
    assert {r.id: (r.mtu, r.duplex) for r in rows.collect()} == {"x": (1500, "full"), "old": (None, None)}


def test_capture_of_late_and_repeated_dumps(spark, tmp_path):
    lake = str(tmp_path / "lake")
    schema = "snapshot_id string, fetched_at timestamp, source_ip string, text string"

    def batch(number, *dumps):
        frame = spark.createDataFrame([("s1", AT, ip, DUMP) for ip in dumps], schema)
        stream_capture.capture_batch(frame, number, lake, writer="w")

    def tags():
        return sorted((r.radio, r.source_role or "-") for r in read_table(spark, lake, "radio_stats").collect())

    batch(0, "10.44.8.6")  # the satellite comes first
    assert tags() == [("wifi0", "-"), ("wifi1", "-")]
    batch(1, None)
    both = [("wifi0", "master"), ("wifi0", "slave"), ("wifi1", "master"), ("wifi1", "slave")]
    assert tags() == both
    batch(2, None, "10.44.8.6", None)
    batch(2, None, "10.44.8.6", None)  # the batch is run again
    assert tags() == both
    capture_to_lake(spark.createDataFrame([("s1", AT, None, DUMP)], schema), lake, f"{lake}/_staging")
    assert tags() == both
    assert read_table(spark, lake, "nic_counter").count() == 2
    assert read_table(spark, lake, "node").count() == 2


def test_streamed_rates_equal_batch_rates(spark, tmp_path):
    """Redelivery, resets, late rows before and between stored ones, and a repeated batch."""
    line = rates.Series(("intf",), ("rx_bytes", "tx_bytes"))
    batches = [
        [("e0", 10, 5, 5), ("e0", 20, 9, 9), ("e1", 10, 1, 1), (None, 10, 1, 1)],
        [("e0", 20, 9, 9), ("e0", 30, 2, 12), ("e1", 20, 4, 4), ("e2", 5, 1, 1)],
        [("e0", 15, 7, 7), ("e0", 40, 8, 20), ("e1", 5, 0, 0), ("e3", 1, 1, 1)],
        [("e0", 12, 6, 6), ("e0", 25, 10, 10), ("e3", 2, 3, 3)],
    ]
    folder = str(tmp_path / "state")
    for k, rows in enumerate(batches):
        for _ in range(2 if k == 2 else 1):
            rates.link_batch(spark.createDataFrame(rows, line.ddl()), k, line, folder)
    got = {(r.intf, r.t_ms): (r.prev_ms, r.rx_bytes, r.prev_rx_bytes) for r in rates.current_links(spark, line, folder).collect()}
    points = sorted({r for b in batches for r in b if r[0]})
    want = {}
    for a, b in zip(points, points[1:]):
        if a[0] == b[0]:
            want[(b[0], b[1])] = (a[1], b[2], a[2])
    assert got == want


def test_streamed_rates_pair_all_rows_of_a_time(spark, tmp_path):
    """Rows of one time with other figures, in one batch and in later ones; redelivery by id and, without one, by figures."""
    batches = [
        [("e0", "a", 10, 5, 5), ("e0", "b", 10, 6, None), ("e0", "c", 20, 9, 9), ("e0", "i", 20, 9, 9), ("e1", "d", 10, 1, 1)],
        [("e0", "e", 20, 8, 7), ("e0", "c", 20, 9, 9), ("e1", "f", 20, 4, 4), ("e1", "g", 20, 4, 5), ("e0", "b", 10, 6, None)],
        [("e0", "h", 10, 3, 3), ("e0", "j", 30, 8, 20), ("e1", "k", 30, 0, 0), ("e1", None, 30, 1, 1)],
        [("e0", "l", 15, 6, 6), ("e1", "m", 30, 10, 10), ("e1", None, 30, 1, 1)],
    ]
    for ids in (1, 0):
        line = rates.Series(("intf",), ("rx_bytes", "tx_bytes"), row_id="id" if ids else None)
        cut = [[r[:1] + r[2 - ids :] for r in rows] for rows in batches]
        folder = str(tmp_path / f"state{ids}")
        for k, rows in enumerate(cut):
            for _ in range(2 if k == 2 else 1):
                rates.link_batch(spark.createDataFrame(rows, line.ddl()), k, line, folder)
        names = [*line.ids, "intf", "t_ms", "prev_ms", "rx_bytes", "tx_bytes", "prev_rx_bytes", "prev_tx_bytes"]
        got = sorted(map(repr, (tuple(r) for r in rates.current_links(spark, line, folder).select(*names).collect())))
        points = {r for b in cut for r in b}
        want = []
        for c in points:
            before = [p for p in points if p[0] == c[0] and p[-3] < c[-3]]
            last = max((p[-3] for p in before), default=None)
            want += [repr((*c[1 : 1 + ids], c[0], c[-3], last, *c[-2:], *p[-2:])) for p in before if p[-3] == last]
        assert got == sorted(want)


def landed(spark, root):
    sats = DUMP.replace("wifi1", "wifi7")
    dumps = spark.createDataFrame(
        [("s1", AT, None, DUMP), ("s1", AT, "10.44.8.6", sats), ("s2", AT, None, "cut off")],
        "snapshot_id string, fetched_at timestamp, source_ip string, text string",
    )
    dump_source.land_dumps(dumps, root)


def test_landed_dumps(spark, tmp_path):
    landed(spark, str(tmp_path / "in"))
    got = {(r.snapshot_id, r.source_ip): (r.fetched_at, r.text) for r in dump_source.read_dumps(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {("s1", None), ("s1", "10.44.8.6"), ("s2", None)}
    assert got[("s1", None)] == (AT, DUMP + "\n")


def test_capture_batch_and_stream_agree(spark, tmp_path):
    root, lake, live = (str(tmp_path / n) for n in ("in", "lake", "live"))
    landed(spark, root)
    dumps = dump_source.read_dumps(spark, root)
    vendors = spark.createDataFrame([(24, "5c1d77", "Acme")], "bits int, prefix string, vendor string")
    lazy = capture(dumps, vendors=vendors)
    capture_to_lake(dumps, lake, f"{lake}/_staging", vendors=vendors)
    stream = dump_source.stream_dumps(spark, root)
    stream_capture.stream_capture(stream, live, f"{live}/_checkpoint", vendors).awaitTermination()
    for table in TABLES:
        ids = sorted(r.id for r in lazy[table].select("id").collect())
        assert len(set(ids)) == len(ids) > 0, table
        assert ids == sorted(r.id for r in read_table(spark, lake, table).select("id").collect())
        assert ids == sorted(r.id for r in read_table(spark, live, table).select("id").collect())
    master = lazy["device"].where("role = 'master'").head()
    assert master.mac_vendor == "Acme" and master.extra_macs_vendor == [None]
    tags = {(r.radio, r.source_role) for r in read_table(spark, lake, "radio_stats").collect()}
    assert tags == {("wifi1", "master"), ("wifi0", "master"), ("wifi7", "slave"), ("wifi0", "slave")}


def test_shared_folder_follows_the_session():
    def named(folder, master="spark://cluster"):
        conf = SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": folder}.get(key, default))
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_folder(named("/shared"), "x").startswith("/shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(named(None), "x")
