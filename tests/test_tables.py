import json

from meshlens.sources import tables


def test_eleven_tables_with_common_prefix():
    assert len(tables.TABLES) == 11
    for table in tables.TABLES:
        schema = tables.schema(table)
        assert schema.names[:3] == ["id", "snapshot_id", "fetched_at"]
        assert [f.nullable for f in schema[:3]] == [False] * 3
        assert all(f.nullable for f in schema[3:])


def test_column_counts():
    counts = {t: len(tables.data_columns(t)) for t in tables.TABLES}
    assert counts == {
        "device": 12, "wlan_client": 8, "backhaul": 10, "ping": 7, "node": 23,
        "radio_stats": 7, "radio_config": 6, "nic_counter": 3, "system": 15,
        "ip_neighbor": 7, "lldp_neighbor": 11,
    }


def test_special_columns_are_declared():
    for columns in (tables.VENDOR_COLUMNS, tables.VENDOR_ARRAY_COLUMNS):
        for table, names in columns.items():
            declared = tables.data_columns(table)
            assert set(names) <= set(declared)
            if isinstance(names, dict):
                assert set(names.values()) <= set(declared)


def test_avro_schema():
    record = json.loads(tables.avro_schema("device"))
    fields = {f["name"]: f["type"] for f in record["fields"]}
    assert list(fields)[:3] == ["id", "snapshot_id", "fetched_at"]
    assert fields["fetched_at"] == {"type": "long", "logicalType": "timestamp-millis"}
    assert fields["mac"] == ["null", "string"]
    assert fields["extra_macs"] == ["null", {"type": "array", "items": ["null", "string"]}]
    neighbor = json.loads(tables.avro_schema("ip_neighbor"))
    assert {f["name"]: f["type"] for f in neighbor["fields"]}["is_router"] == ["null", "boolean"]


def test_conform_orders_and_fills(spark):
    rows = spark.createDataFrame([("1", "eth0", "7")], "id string, intf string, rx_bytes string")
    out = tables.conform(rows, "nic_counter")
    assert out.columns == tables.schema("nic_counter").names
    assert [f.dataType for f in out.schema] == [f.dataType for f in tables.schema("nic_counter")]
    assert out.head().rx_bytes == 7 and out.head().tx_bytes is None
