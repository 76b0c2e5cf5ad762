"""Replay of buffer files by name: order, bounds, failures, crashes."""

import datetime as dt
import json
import os

import pytest

from meshlens.sinks import buffer as buffer_sink
from meshlens.sinks import messages
from meshlens.sinks.lake import read_table
from meshlens.sources.buffer import pending_files
from meshlens.streaming import ordered

AT_MS = 1959908861123
AT = dt.datetime(2032, 2, 9, 3, 7, 41)


def put(folder, name, *values, age=0):
    lines = [
        json.dumps({"key": "s", "value": {"id": i, "snapshot_id": "s", "fetched_at": {"__dt_ms__": AT_MS}, "intf": "e0", "rx_bytes": n}})
        for i, n in values
    ]
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f"{x}\n" for x in lines))
    os.utime(folder / name, (1_700_000_000 - age,) * 2)


class Sink:
    """Takes messages, and fails for the files it is told to."""

    def __init__(self, *down):
        self.down, self.got, self.steps = set(down), [], []

    def __call__(self, batch, step):
        rows = batch.collect()
        self.steps.append(step)
        for name in sorted({r.arrival for r in rows}):
            if name in self.down:
                raise ConnectionError("down")
            self.got += [(name, json.loads(r.value)["id"]) for r in rows if r.arrival == name]


@pytest.fixture
def buffer(tmp_path):
    folder = tmp_path / "buffer"
    # The later the name, the older the file.
    for k, name in enumerate(["mesh.nic_counter.20260625_090001", "mesh.nic_counter.20260625_090001-1", "mesh.nic_counter.20260625_090002", "mesh.ping.20260625_080000"]):
        put(folder, name, (f"u{k}", k), age=1000 * k)
    put(folder, "mesh.nic_counter.20260625_090003.gz", ("no", 1))
    put(folder, "mesh.nic_counter.20260625_090003.part", ("no", 1))
    put(folder, "notes.txt", ("no", 1))
    return folder


def names(buffer):
    return sorted(p.name for p in buffer.iterdir() if p.name.startswith("mesh") and p.suffix not in (".gz", ".part"))


def test_files_go_in_the_order_of_their_names(spark, buffer, tmp_path):
    assert pending_files(spark, str(buffer)) == names(buffer)
    sink = Sink()
    report = ordered.drain(spark, str(buffer), str(tmp_path / "l"), sink, files_per_step=1)
    assert list(report.sent) == names(buffer) == [name for name, _ in sink.got] and report.failed is None
    assert ordered.drain(spark, str(buffer), str(tmp_path / "l"), sink).sent == {}
    put(buffer, "mesh.device.20200101_000000", ("late", 1))
    assert list(ordered.drain(spark, str(buffer), str(tmp_path / "l"), sink).sent) == ["mesh.device.20200101_000000"]


@pytest.mark.parametrize("per_step", [1, 3, 100])
def test_stops_at_the_first_failing_file(spark, buffer, tmp_path, per_step):
    files, ledger = names(buffer), str(tmp_path / "l")
    sink = Sink(files[2])
    report = ordered.drain(spark, str(buffer), ledger, sink, files_per_step=per_step)
    assert list(report.sent) == files[:2] and report.failed == files[2] and "down" in report.error
    assert files[3] not in {name for name, _ in sink.got[2 * (per_step > 1) :]}
    report = ordered.drain(spark, str(buffer), ledger, sink, files_per_step=per_step)
    assert report.sent == {} and report.failed == files[2]  # still the first one
    sink.down.clear()
    report = ordered.drain(spark, str(buffer), ledger, sink, files_per_step=per_step)
    assert list(report.sent) == files[2:] and report.sent[files[2]] == 1


def test_bounds(spark, buffer, tmp_path):
    files, ledger = names(buffer), str(tmp_path / "l")
    assert list(ordered.drain(spark, str(buffer), ledger, Sink(), most_files=3).sent) == files[:3]
    assert ordered.drain(spark, str(buffer), ledger, Sink(), time_limit=0).sent == {}
    assert ordered.drain(spark, str(buffer), ledger, Sink(), most_files=0).sent == {}
    assert list(ordered.drain(spark, str(buffer), ledger, Sink(), time_limit=600).sent) == files[3:]


def test_sent_files_are_archived(spark, buffer, tmp_path):
    files, archive = names(buffer), tmp_path / "archive"
    report = ordered.drain(spark, str(buffer), str(tmp_path / "l"), Sink(files[1]), archive=str(archive), files_per_step=1)
    assert list(report.sent) == files[:1]
    assert [p.name for p in archive.iterdir() if not p.name.startswith(".")] == files[:1] and names(buffer) == files[1:]


def test_a_crash_between_delivery_and_ledger_repeats_the_step(spark, buffer, tmp_path, monkeypatch):
    files, ledger, lake = names(buffer), str(tmp_path / "l"), str(tmp_path / "lake")

    def crash(self, step):
        raise KeyboardInterrupt

    monkeypatch.setattr(ordered.Ledger, "finish", crash)
    with pytest.raises(KeyboardInterrupt):
        ordered.drain_to_lake(spark, str(buffer), ledger, lake, files_per_step=2)
    monkeypatch.undo()
    put(buffer, "mesh.nic_counter.20260101_000000", ("early", 1))  # the planned step comes first all the same
    report = ordered.drain_to_lake(spark, str(buffer), ledger, lake, files_per_step=2)
    assert list(report.sent)[:2] == files[:2] and len(report.sent) == 5
    assert sorted(r.id for r in read_table(spark, lake, "nic_counter").collect()) == ["early", "u0", "u1", "u2"]
    assert sorted(p.name for p in (tmp_path / "lake/nic_counter").glob("day=*/writer=*/batch=*")) == ["batch=0", "batch=1"]


def test_later_name_wins_in_the_lake(spark, tmp_path):
    folder, lake = tmp_path / "buffer", str(tmp_path / "lake")
    for k in range(3):
        put(folder, f"mesh.nic_counter.20260625_09000{k}", ("u", k), ("x", 7), age=1000 * k)
    for per_step in (1, 100):
        ordered.drain_to_lake(spark, str(folder), f"{lake}-{per_step}/_ledger", f"{lake}-{per_step}", files_per_step=per_step)
        got = {r.id: r.rx_bytes for r in read_table(spark, f"{lake}-{per_step}", "nic_counter").collect()}
        assert got == {"u": 2, "x": 7}


def test_buffer_files_are_named_by_topic_and_time(spark, tmp_path):
    folder = str(tmp_path / "buffer")
    rows = spark.createDataFrame([("a", "s", AT), ("b", "s", AT)], "id string, snapshot_id string, fetched_at timestamp")
    sent = messages.all_messages({t: rows for t in ("ping", "device")}, marked_time=True).coalesce(1)
    assert sorted(buffer_sink.write_files(sent, folder, AT)) == ["mesh.device.20320209_030741", "mesh.ping.20320209_030741"]
    assert sorted(buffer_sink.write_files(sent, folder, AT)) == ["mesh.device.20320209_030741-1", "mesh.ping.20320209_030741-1"]
    assert buffer_sink.write_files(sent.limit(0), folder, AT) == []
    sink = Sink()
    report = ordered.drain(spark, folder, str(tmp_path / "l"), sink)
    assert set(report.sent.values()) == {2} and len(sink.got) == 8
    assert {p.name for p in (tmp_path / "buffer").iterdir() if not p.name.startswith(".")} == set(report.sent)


def test_folder_layout_in_order(spark, tmp_path):
    folder = str(tmp_path / "buffer")
    rows = spark.createDataFrame([(str(k), "s", AT) for k in range(4)], "id string, snapshot_id string, fetched_at timestamp")
    buffer_sink.write_buffer(messages.messages(rows, "ping", marked_time=True).repartition(2), folder)
    sink = Sink()
    report = ordered.drain(spark, folder, str(tmp_path / "l"), sink)
    assert len(report.sent) == 2 and sum(report.sent.values()) == 4 and all(n.startswith("topic=mesh.ping/") for n in report.sent)
