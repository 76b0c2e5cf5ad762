import pytest
from pyspark.sql import functions as F

from meshlens.functions.macs import oui_of
from meshlens.operators import names, vendors
from meshlens.operators.identity import tag_source, with_ids
from meshlens.sources.names import parse_payloads
from meshlens.sources.vendors import parse_vendor_lines, read_vendor_file

LINES = [
    "#prefix\tshort\tlong",
    "5A:0C:71\tNorth\tNorthwind Radio",
    "   ",
    "5a-0c-71\tNorth2\tNorthwind Radio Group",
    "one word",
    "86:F2:0D\tPool\tShared Address Pool",
    "86:F2:0D:40/28\tHarbour\tHarbour Switches",
    "86:F2:0D:47:70:00/36\tQuay\tQuay Sensors",
    "86:F2:0D:47:7B:10/44\tPier\tPier Meters",
    "3D90E4\tBare digits",
    "3D:90:E5\t  \t",
    "3D:90:E6\t\tLong name alone",
    "4F:1/24\tmask longer than its digits",
    "4F:12:34/many\tmask is a word",
    "6E/8\tEighth",
    "6E:5/12\tTwelfth",
]


@pytest.fixture(scope="module")
def table(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no int, line string")
    return parse_vendor_lines(lines)


def test_oui_of(spark):
    """Any spelling of at least six hexadecimal digits; separators do not count."""
    spellings = {
        "3d.90.e4.01.02.03": "3D:90:E4",
        " 3D90:E401:0203 ": "3D:90:E4",
        "6e5b2f": "6E:5B:2F",
        "6e5b2": None,
        "no hex": None,
        "::": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in spellings], "mac string")
    got = {r.mac: r.oui for r in df.select("mac", F.expr(oui_of("mac")).alias("oui")).collect()}
    assert got == spellings


def test_vendor_lines(table):
    got = {(r.bits, r.prefix): r.vendor for r in table.collect()}
    assert got == {
        (8, "6e"): "Eighth",
        (12, "6e5"): "Twelfth",
        (24, "5a0c71"): "Northwind Radio Group",
        (24, "86f20d"): "Shared Address Pool",
        (24, "3d90e4"): "Bare digits",
        (24, "3d90e6"): "Long name alone",
        (28, "86f20d4"): "Harbour Switches",
        (36, "86f20d477"): "Quay Sensors",
        (44, "86f20d477b1"): "Pier Meters",
    }


def test_vendor_file(spark, tmp_path):
    path = tmp_path / "vendors"
    path.write_text("\r\n".join(LINES), encoding="utf-8")
    assert read_vendor_file(spark, str(path)).count() == 9
    assert read_vendor_file(spark, str(tmp_path / "missing")).count() == 0


def test_longest_prefix(spark, table):
    """Each longer block takes its part out of the shorter one; unmatched addresses stay."""
    expected = {
        "86:f2:0d:47:7b:1f": "Pier Meters",
        "86:f2:0d:47:7b:20": "Quay Sensors",
        "86-F2-0D-48-00-00": "Harbour Switches",
        "86:f2:0d:50:00:00": "Shared Address Pool",
        "6e:5f:00:00:00:01": "Twelfth",
        "6e:60:00:00:00:01": "Eighth",
        "99:99:99:00:00:00": None,
        "": None,
    }
    df = spark.createDataFrame([(m,) for m in [*expected, *expected, None]], "mac string")
    found = vendors.longest_prefix(df, table).collect()
    assert {r.mac: r.vendor for r in found} == expected and len(found) == len(expected)


def test_vendor_columns_use_24_bits_only(spark, table):
    rows = spark.createDataFrame(
        [("a", "86:f2:0d:47:7b:1f", ["5A0C71000001", None, "?"]), ("b", "6e:5f:00:00:00:01", []),
         ("c", None, None), ("d", "6e:60:00:00:00:01", ["3d90e4aaaaaa", "3d90e4aaaaaa"])],
        "id string, mac string, extra_macs array<string>",
    )
    got = {
        r.id: (r.mac_vendor, r.extra_macs_vendor)
        for r in vendors.with_vendors(rows, vendors.oui_table(table), "device").collect()
    }
    assert got == {
        "a": ("Shared Address Pool", ["Northwind Radio Group", None, None]),
        "b": ("Twelfth", []),
        "c": (None, []),
        "d": ("Eighth", ["Bare digits", "Bare digits"]),
    }


def test_short_masks_add_no_rows(spark):
    lines = [(k, f"{k:X}0/4\tv{k}") for k in range(16)]
    made = parse_vendor_lines(spark.createDataFrame(lines, "line_no int, line string"))
    assert vendors.oui_table(made).count() == 16
    rows = spark.createDataFrame([(f"{k:x}1:22:33:44:55:66",) for k in range(16)], "mac string")
    got = {r.mac[0]: r.vendor for r in vendors.with_vendor(rows, vendors.oui_table(made), "mac", "vendor").collect()}
    assert got == {f"{k:x}": f"v{k}" for k in range(16)}


def test_no_vendor_file_gives_null(spark):
    none = spark.createDataFrame([], "bits int, prefix string, vendor string")
    rows = spark.createDataFrame([("1", "5a:0c:71:00:00:00")], "id string, mac string")
    got = vendors.with_vendor(rows, vendors.oui_table(none), "mac", "mac_vendor").head()
    assert got.mac_vendor is None


PAYLOAD = """{"output": {"devices": [
 {"friendlyName": "Garden camera\\n", "deviceID": "Cam-7", "knownInterfaces": [{"macAddress": "5a:0c:71:aa:00:01"}, {"macAddress": "5a:0c:71:aa:00:02", "x": 1}]},
 7, {"deviceID": "", "friendlyName": "Desk lamp", "knownInterfaces": [{"macAddress": "86:F2:0D:00:00:09"}, 3, {"macAddress": null}]},
 {"deviceID": "cam-8", "friendlyName": "   ", "knownInterfaces": [{"macAddress": "86:f2:0d:00:00:0a"}]},
 [], {"deviceID": "Plug", "friendlyName": "Heater plug"}, {"deviceID": "tv", "friendlyName": "Later name", "knownInterfaces": [{"macAddress": "5A:0C:71:AA:00:02"}]}
 ]}, "result": "OK"}"""


@pytest.fixture(scope="module")
def payloads(spark):
    raw = [("s", PAYLOAD), ("refused", '{"result": "ErrorX", "output": {}}'), ("cut", PAYLOAD[:90]), ("bare", '{"output": 5}')]
    return parse_payloads(spark.createDataFrame(raw, "snapshot_id string, payload string"))


def test_name_index(payloads):
    got = {(r.snapshot_id, r.key): r.name for r in names.name_index(payloads).collect()}
    assert got == {
        ("s", "cam-7"): "Garden camera",
        ("s", "5A:0C:71:AA:00:01"): "Garden camera",
        ("s", "5A:0C:71:AA:00:02"): "Garden camera",
        ("s", "86:F2:0D:00:00:09"): "Desk lamp",
        ("s", "plug"): "Heater plug",
        ("s", "tv"): "Later name",
    }


def test_friendly_names(spark, payloads):
    devices = spark.createDataFrame(
        [("by id", "s", "PLUG", "5a:0c:71:aa:00:01", []),
         ("by mac", "s", "unknown", "86:f2:0d:00:00:09", ["5a:0c:71:aa:00:01"]),
         ("by other mac", "s", None, None, ["00", "5A:0c:71:aa:00:02", "5a:0c:71:aa:00:01"]),
         ("blank name", "s", "CAM-8", "86:f2:0d:00:00:0a", None),
         ("elsewhere", "refused", "plug", None, [])],
        "id string, snapshot_id string, uuid string, mac string, extra_macs array<string>",
    )
    named = names.with_friendly_names(devices, names.name_maps(payloads))
    got = {r.id: r.friendly_name for r in named.collect()}
    assert got == {
        "by id": "Heater plug", "by mac": "Desk lamp", "by other mac": "Garden camera",
        "blank name": None, "elsewhere": None,
    }
    coverage = {r.snapshot_id: (r.named, r.devices) for r in names.name_coverage(named).collect()}
    assert coverage == {"s": (3, 4), "refused": (0, 1)}


def test_source_tags_and_ids(spark):
    nodes = spark.createDataFrame(
        [("s", 0, "m1", "Main", "10.0.0.1", "master"), ("s", 1, "m2", "Hall", "10.0.0.2", "slave"),
         ("s", 2, "m9", "Second", "10.0.0.9", "master"), ("s", 3, "m4", "Lost", None, "slave")],
        "snapshot_id string, pos int, mac string, name string, ip string, role string",
    )
    rows = spark.createDataFrame(
        [("s", None, 0), ("s", "10.0.0.2", 0), ("s", "10.0.0.7", 0), ("t", None, 0)],
        "snapshot_id string, source_ip string, pos int",
    )
    tagged = with_ids(tag_source(rows, nodes), "system")
    got = {(r.snapshot_id, r.source_ip): (r.source_node_mac, r.source_role) for r in tagged.collect()}
    assert got == {
        ("s", None): ("m1", "master"),
        ("s", "10.0.0.2"): ("m2", "slave"),
        ("s", "10.0.0.7"): (None, None),
        ("t", None): (None, None),
    }
    ids = [r.id for r in tagged.collect()]
    assert len(set(ids)) == 4 and all(len(i) == 64 for i in ids)
    assert [r.id for r in with_ids(tagged.withColumn("id", F.lit("kept")), "system").collect()] == ["kept"] * 4


def test_nested_blocks_of_all_lengths(spark):
    """Blocks inside blocks, shorter and longer than 24 bits; the longest one that holds the address counts."""
    blocks = [(8, "5e", "eight"), (20, "5e702", "twenty"), (24, "5e702b", "oui"), (28, "5e702b1", "small"), (36, "5e702b123", "tiny"), (36, "aabbccdde", "alone")]
    table = spark.createDataFrame(blocks, "bits int, prefix string, vendor string")
    want = {
        "5E:70:2B:12:3F:00": "tiny", "5e702b1fffff": "small", "5E:70:2B:FF:FF:FF": "oui", "5e:70:2c:00:00:00": "twenty",
        "5E-00-00-00-00-00": "eight", "AA:BB:CC:DD:EF:00": "alone", "AA:BB:CC:DE:00:00": None, "5E": "eight", "zz": None,
    }
    macs = spark.createDataFrame([(m,) for m in [*want, *want, None]], "mac string")
    for lengths in (range(9), (6, 7, 9), (6,)):
        kept = table.where(F.length("prefix").isin(*lengths))
        best = {m: max(((len(p), v) for _, p, v in blocks if len(p) in lengths and "".join(c for c in m.lower() if c in "0123456789abcdef").startswith(p)), default=(0, None))[1] for m in want}
        assert {r.mac: r.vendor for r in vendors.longest_prefix(macs, kept).collect()} == best
    assert best != want and vendors.longest_prefix(macs, table).count() == len(want)


def test_sketches_roll_up(spark):
    from meshlens.plans import sketches

    rows = spark.range(6000).selectExpr(
        "timestamp_millis(1704067200000 + id % 48 * 3600000) AS fetched_at", "IF(id % 7 = 0, 'inet6', 'inet') AS family",
        "IF(id % 2 = 0, 'br0', NULL) AS iface", "IF(id % 11 = 0, NULL, CAST(id % 700 AS STRING)) AS mac",
    )
    kept = sketches.neighbor_sketches(rows)
    assert kept.count() == 48
    for unit, n in (("hour", 48), ("day", 4), ("year", 2)):
        found = sketches.live_hosts(kept, unit)
        exact = rows.where("family = 'inet'").groupBy(F.date_trunc(unit, "fetched_at").alias("span"), "iface").agg(F.count_distinct("mac").alias("n"))
        got = {(r.span, r.subnet): r.live_hosts for r in found.collect()}
        assert len(got) == n
        for r in exact.collect():
            assert abs(got[r.span, r.iface and "Main LAN"] - r.n) <= sketches.ERROR * r.n
