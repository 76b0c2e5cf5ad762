"""Declared schemas of the eleven snapshot tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Table names, column order and types are the data model.
PREFIX = {"id": "string", "snapshot_id": "string", "fetched_at": "timestamp"}
COLUMNS = {
    "device": """
        uuid string, mac string, mac_vendor string, ip string, conn string, status string,
        name string, friendly_name string, fw_ver string, role string,
        extra_macs array<string>, extra_macs_vendor array<string>""",
    "wlan_client": """
        client_mac string, client_mac_vendor string, stat string, net string, node string,
        mcs string, rssi int, last_seen string""",
    "backhaul": """
        node_mac string, node_mac_vendor string, node_ip string, parent_ip string, intf string,
        chan string, rssi string, speed double, state string, timestamp bigint""",
    "ping": """
        target string, transmitted int, received int, loss_pct double, rtt_min double,
        rtt_avg double, rtt_max double""",
    "node": """
        uuid string, mac string, mac_vendor string, ip string, name string, role string,
        sku string, serial_number string, fw_ver string, mode string, model_base string,
        model_number string, hw_version string,
        userap2g_bssid string, userap2g_bssid_vendor string, userap2g_channel string,
        userap5gl_bssid string, userap5gl_bssid_vendor string, userap5gl_channel string,
        userap5gh_bssid string, userap5gh_bssid_vendor string, userap5gh_channel string,
        devinfo string""",
    "radio_stats": """
        radio string, band string, source_node_mac string, source_node_name string,
        source_node_ip string, source_role string, stats string""",
    "radio_config": """
        interface string, ssid string, mac string, mac_vendor string, frequency string,
        settings string""",
    "nic_counter": "intf string, rx_bytes bigint, tx_bytes bigint",
    "system": """
        uptime_secs bigint, load_1 double, load_5 double, load_15 double, mem_total bigint,
        mem_used bigint, mem_free bigint, mem_shared bigint, mem_buffers bigint,
        mem_cached bigint, cpu_idle_pct double, source_node_mac string,
        source_node_name string, source_node_ip string, source_role string""",
    "ip_neighbor": """
        ip string, family string, iface string, mac string, mac_vendor string,
        is_router boolean, state string""",
    "lldp_neighbor": """
        interface string, rid string, chassis_id string, chassis_id_vendor string,
        sys_name string, sys_descr string, mgmt_ip string, port_id string,
        port_id_vendor string, port_descr string, capabilities string""",
}
# (hardware address -> vendor) column pairs.
VENDOR_COLUMNS = {
    "device": {"mac": "mac_vendor"},
    "wlan_client": {"client_mac": "client_mac_vendor"},
    "backhaul": {"node_mac": "node_mac_vendor"},
    "node": {
        "mac": "mac_vendor",
        "userap2g_bssid": "userap2g_bssid_vendor",
        "userap5gl_bssid": "userap5gl_bssid_vendor",
        "userap5gh_bssid": "userap5gh_bssid_vendor",
    },
    "radio_config": {"mac": "mac_vendor"},
    "ip_neighbor": {"mac": "mac_vendor"},
    "lldp_neighbor": {"chassis_id": "chassis_id_vendor", "port_id": "port_id_vendor"},
}
VENDOR_ARRAY_COLUMNS = {"device": {"extra_macs": "extra_macs_vendor"}}

TABLES = tuple(COLUMNS)

#: Holds fields that arrive beyond a table's declared columns, by name.
ADDED = "added"

_AVRO = {
    T.StringType(): "string",
    T.IntegerType(): "int",
    T.LongType(): "long",
    T.DoubleType(): "double",
    T.BooleanType(): "boolean",
    T.ArrayType(T.StringType()): {"type": "array", "items": ["null", "string"]},
}


def schema(table: str) -> T.StructType:
    """Full schema: the three prefix fields (never NULL), then the nullable data columns."""
    prefix = [
        T.StructField(name, T.StructType.fromDDL(f"c {kind}")["c"].dataType, False)
        for name, kind in PREFIX.items()
    ]
    return T.StructType(prefix + T.StructType.fromDDL(COLUMNS[table]).fields)


def data_columns(table: str) -> list[str]:
    return T.StructType.fromDDL(COLUMNS[table]).names


def conform(df: DataFrame, table: str, further: list[str] | None = None) -> DataFrame:
    """Columns in declared order and type, missing ones NULL, then those named in ``further``."""
    wanted = schema(table)
    present = set(df.columns)
    return df.selectExpr(
        *(
            f"CAST({f'`{f.name}`' if f.name in present else 'NULL'}"
            f" AS {f.dataType.simpleString()}) AS `{f.name}`"
            for f in wanted
        ),
        *(further or []),
    )


def avro_schema(table: str, namespace: str = "mesh") -> str:
    """Avro record schema of a table's messages; every data field is a nullable union."""
    fields: list[dict] = [
        {"name": "id", "type": "string"},
        {"name": "snapshot_id", "type": "string"},
        {"name": "fetched_at", "type": {"type": "long", "logicalType": "timestamp-millis"}},
    ]
    for f in T.StructType.fromDDL(COLUMNS[table]):
        fields.append({"name": f.name, "type": ["null", _AVRO[f.dataType]], "default": None})
    return json.dumps(
        {"type": "record", "name": table, "namespace": namespace, "fields": fields}
    )
