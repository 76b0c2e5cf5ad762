"""Dumps rendered from the given documents, and the rows they must give back.

Every document becomes the dump of one master node (and of a satellite): its whole text as
noise, then all sections with ``1 + doc_id % 5`` rows each, between decoys. ``ROWS`` states the
values once, as SQL both engines read; Spark prints them into text, the oracle selects them.
In the expressions ``d`` is the document id, ``i`` the row number, ``n`` the text length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import source

HEX2 = "lpad(hex({0}), 2, '0')"


def _text(number: str) -> str:
    return f"CAST({number} AS VARCHAR(20))"


NODE_MAC = f"'5E:70:2B:' || {HEX2.format('d % 251')} || ':00:' || {HEX2.format('i')}"
UUID = "lpad(hex(d), 8, '0') || '-0000-0000-0000-' || lpad(hex(i), 12, '0')"
IP = f"'10.77.' || {_text('d % 250')} || '.' || {_text('i + 1')}"
FW = f"'1.0.' || {_text('n')}"
ROLE = "CASE WHEN i = 0 THEN 'master' WHEN i < 3 THEN 'slave' ELSE 'client' END"
DEVICE_IP = f"CASE WHEN i > 2 AND (d + i) % 3 = 0 THEN NULL ELSE {IP} END"
NAME = (
    "CASE WHEN (d + i) % 5 = 0 THEN NULL WHEN (d + i) % 5 = 1 THEN 'Orlaâ€™s ' || lang || '..'"
    " ELSE lang || '-' || source END"
)
DEVICE_FW = f"CASE WHEN i % 3 = 2 THEN NULL ELSE {FW} END"
EXTRA = [f"'62:9d:00:' || {HEX2.format('d % 256')} || ':0{k}:' || {HEX2.format('i')}" for k in (1, 2)]
HAS_INFO = "i < 3 AND (d + i) % 4 != 3"
SPEED = f"{_text('d % 1000')} || '.25'"
RSSI = "CASE WHEN (d + i) % 7 = 0 THEN NULL ELSE CAST(-30 - (d + i) % 60 AS INTEGER) END"
BAND = "CASE i % 3 WHEN 0 THEN '2.4G' WHEN 1 THEN '5G low' ELSE '5G high' END"

# table -> column -> SQL over (d, i, n, lang, source)
ROWS: dict[str, dict[str, str]] = {
    "device": {
        "uuid": UUID,
        "mac": NODE_MAC,
        "ip": DEVICE_IP,
        "conn": "CASE WHEN i % 2 = 0 THEN 'wired' ELSE 'wifi' END",
        "status": "CASE WHEN (d + i) % 4 = 0 THEN 'Down' ELSE 'Up' END",
        "name": NAME,
        "fw_ver": DEVICE_FW,
        "role": ROLE,
        "extra_macs": (
            f"CASE (d + i) % 3 WHEN 0 THEN '' WHEN 1 THEN {EXTRA[0]}"
            f" ELSE {EXTRA[0]} || ',' || {EXTRA[1]} END"
        ),
    },
    "wlan_client": {
        "client_mac": f"'b4:6f:02:' || lower({HEX2.format('d % 256')}) || ':00:0' || {_text('i')}",
        "stat": "CASE WHEN i % 2 = 0 THEN 'up' ELSE 'idle' END",
        "net": "'br' || " + _text("i % 3"),
        "node": "lpad(hex(d * 7 + i), 12, '0')",
        "mcs": f"CASE WHEN (d + i) % 3 = 0 THEN 'RSN' ELSE {_text('(d + i) % 300')} END",
        "rssi": RSSI,
        "last_seen": f"'2032-02-' || {_text('10 + d % 20')} || 'T21:14:05Z'",
    },
    "backhaul": {
        "node_mac": "lpad(hex(d * 16 + i), 12, '0')",
        "node_ip": IP,
        "parent_ip": f"CASE WHEN i % 2 = 1 THEN NULL ELSE '10.77.' || {_text('d % 250')} || '.1' END",
        "intf": "CASE WHEN i % 2 = 0 THEN 'eth1' ELSE '5GL' END",
        "chan": f"CASE WHEN i % 2 = 0 THEN 'wired' ELSE {_text('36 + i')} END",
        "rssi": f"CASE WHEN i % 2 = 0 THEN NULL ELSE {_text('-40 - d % 40')} END",
        "speed": f"CASE WHEN (d + i) % 6 = 0 THEN NULL ELSE CAST({SPEED} AS DOUBLE) END",
        "state": "CASE WHEN d % 2 = 0 THEN 'up' ELSE 'down' END",
        "timestamp": "CAST(1959822461 + d AS BIGINT)",
    },
    "node": {
        "uuid": UUID,
        "mac": NODE_MAC,
        "ip": DEVICE_IP,
        "name": NAME,
        "role": ROLE,
        "sku": f"CASE WHEN {HAS_INFO} THEN 'MX' || {_text('d')} || '-' || upper(lang) END",
        "serial_number": f"CASE WHEN {HAS_INFO} AND d % 2 = 0 THEN 'S\"' || {_text('n')} || '}}' END",
        "fw_ver": f"CASE WHEN {HAS_INFO} AND d % 3 != 0 THEN '2.' || {_text('d')} ELSE {DEVICE_FW} END",
        "mode": f"CASE WHEN {HAS_INFO} THEN {ROLE} END",
        "model_base": f"CASE WHEN {HAS_INFO} THEN 'MX' || {_text('d % 90')} END",
        "model_number": f"CASE WHEN {HAS_INFO} AND d % 5 != 0 THEN 'MX' || {_text('d % 90')} || '-' || lang END",
        "hw_version": f"CASE WHEN {HAS_INFO} THEN {_text('1 + i')} END",
        "userap2g_bssid": f"CASE WHEN {HAS_INFO} THEN {NODE_MAC} END",
        "userap2g_channel": f"CASE WHEN {HAS_INFO} THEN {_text('1 + (d + i) % 11')} END",
        "userap5gl_bssid": f"CASE WHEN {HAS_INFO} AND d % 3 != 1 THEN lower({NODE_MAC}) END",
        "userap5gl_channel": f"CASE WHEN {HAS_INFO} AND d % 3 != 1 THEN {_text('36 + i')} END",
        "userap5gh_bssid": f"CASE WHEN {HAS_INFO} AND d % 2 = 1 THEN {NODE_MAC} END",
        "userap5gh_channel": f"CASE WHEN {HAS_INFO} AND d % 2 = 1 THEN {_text('100 + i')} END",
        # Of the whole object: a text inside a list of an object, and the number of its keys.
        "info_nested": f"CASE WHEN {HAS_INFO} THEN '}}' END",
        "info_keys": f"CAST(CASE WHEN {HAS_INFO} THEN 8 + CASE WHEN d % 2 = 0 THEN 1 ELSE 2 END + CASE WHEN d % 5 != 0 THEN 1 ELSE 0 END + 2 ELSE 0 END AS BIGINT)",
    },
    "radio_stats": {
        "radio": "'wifi' || " + _text("i"),
        "band": BAND,
        "tx_data_bytes": _text("d * 1000000007 + i"),
        "rx_rssi": _text("20 + (d + i) % 40"),
        "obss_chan_util": f"CASE WHEN (d + i) % 4 = 0 THEN '<DISABLED>' ELSE {_text('d % 200')} END",
        "tx_per_ac_best_effort": _text("n + i"),
        "rx_per_ac_best_effort": _text("n * 2 + i"),
        "noise_dbm": f"'-9' || {_text('i')} || '.5'",
    },
    "radio_config": {
        "interface": "'ath' || " + _text("i"),
        "ssid": "CASE WHEN (d + i) % 4 = 0 THEN NULL ELSE 'net: ' || source || ' ' || lang END",
        "mac": NODE_MAC,
        "frequency": f"'2.' || {_text('400 + i')} || 'GHz'",
        "chwidth": _text("i % 4"),
        "mode": f"'11G' || upper(lang) || {_text('d')}",
        "disablecoext": _text("d % 2"),
    },
    "nic_counter": {
        "intf": "CASE WHEN i = 0 THEN 'br0' ELSE 'eth' || " + _text("i - 1") + " END",
        "rx_bytes": "CAST(d * 70214883391 + i AS BIGINT)",
        "tx_bytes": "CAST(n * 1000 + i AS BIGINT)",
    },
    "ip_neighbor": {
        "ip": f"CASE WHEN i % 2 = 0 THEN {IP} ELSE 'fe80::' || lower(hex(d)) || ':' || {_text('i')} END",
        "family": "CASE WHEN i % 2 = 0 THEN 'inet' ELSE 'inet6' END",
        "iface": "'br' || " + _text("(d + i) % 3"),
        "mac": f"CASE WHEN (d + i) % 4 = 0 THEN NULL ELSE lower({NODE_MAC}) END",
        "is_router": "(d + i) % 3 = 1",
        "state": "CASE (d + i) % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'STALE' WHEN 2 THEN NULL ELSE 'REACHABLE' END",
    },
    "lldp_neighbor": {
        "interface": "'eth' || " + _text("i"),
        "rid": _text("10 + i"),
        "chassis_id": f"lower({NODE_MAC})",
        "sys_name": "CASE WHEN i % 2 = 0 THEN 'AP' || " + _text("d") + " END",
        "sys_descr": "'Node: ' || lang || ' ' || source",
        "mgmt_ip": f"CASE WHEN i % 3 = 0 THEN {IP} END",
        "port_id": f"CASE WHEN i % 2 = 0 THEN lower({NODE_MAC}) ELSE 'port' || {_text('i')} END",
        "port_descr": "'eth' || " + _text("i"),
        "bridge": "'true'",
        "station": "CASE WHEN (d + i) % 2 = 0 THEN 'true' ELSE 'false' END",
    },
    # One row per dump: i is 0.
    "ping": {
        "target": "'www.' || source || '.example'",
        "transmitted": "CAST(2 + d % 5 AS INTEGER)",
        "received": "CAST(CASE WHEN d % 4 = 0 THEN 0 ELSE 2 + d % 5 END AS INTEGER)",
        "loss_pct": "CAST(CASE WHEN d % 4 = 0 THEN 100 ELSE 0 END AS DOUBLE)",
        "rtt_min": f"CASE WHEN d % 4 = 0 THEN NULL ELSE CAST({_text('d % 90')} || '.125' AS DOUBLE) END",
        "rtt_avg": f"CASE WHEN d % 4 = 0 THEN NULL ELSE CAST({_text('d % 90 + 1')} || '.25' AS DOUBLE) END",
        "rtt_max": f"CASE WHEN d % 4 = 0 THEN NULL ELSE CAST({_text('d % 90 + 2')} || '.5' AS DOUBLE) END",
    },
    "system": {
        "uptime_secs": (
            "CAST(CASE WHEN d % 3 = 0 THEN (d % 60) * 60"
            " WHEN d % 3 = 1 THEN (d % 24) * 3600 + (d % 60) * 60"
            " ELSE (d % 400) * 86400 + (d % 24) * 3600 + (d % 60) * 60 END AS BIGINT)"
        ),
        "load_1": f"CAST('1.' || {_text('10 + d % 90')} AS DOUBLE)",
        "load_5": f"CAST('2.' || {_text('10 + d % 80')} AS DOUBLE)",
        "load_15": f"CAST('3.' || {_text('10 + d % 70')} AS DOUBLE)",
        "mem_total": "CAST(903552 + d AS BIGINT)",
        "mem_used": "CAST(511004 + d AS BIGINT)",
        "mem_free": "CAST(392548 + n AS BIGINT)",
        "mem_shared": "CAST(d AS BIGINT)",
        "mem_buffers": "CAST(n AS BIGINT)",
        "mem_cached": "CAST(n + d AS BIGINT)",
        "cpu_idle_pct": f"CAST({_text('d % 100')} || '.5' AS DOUBLE)",
    },
}
SINGLE = ("ping", "system")
# Rows that Spark must print but not give back, or that the oracle must not expect.
ORACLE_FILTER = {"node": "i < 3"}


def expected(table: str) -> str:
    """DuckDB select of the rows a table must hold, one per dump and row number."""
    rows = "1" if table in SINGLE else "1 + doc_id % 5"
    columns = ",\n  ".join(f"{sql} AS {name}" for name, sql in ROWS[table].items())
    where = f"\nWHERE {ORACLE_FILTER[table]}" if table in ORACLE_FILTER else ""
    return (
        f"SELECT 'doc' || CAST(d AS VARCHAR(20)) AS snapshot_id,\n  {columns}\n"
        "FROM (SELECT doc_id AS d, n_chars AS n, lang, source,"
        f" unnest(range({rows})) AS i FROM documents) x{where}"
    )


def _spark(sql: str) -> str:
    """Spark form of a row expression: NULL prints as nothing."""
    return f"coalesce(CAST(({sql}) AS STRING), '')"


def _each(line: str) -> str:
    return f"array_join(transform(sequence(0, k - 1), i -> {line}), '\\n')"


def _fixed(table: str, widths: list[int]) -> tuple[str, str, str]:
    """Header, rule and row of a fixed-width table."""
    columns = [c for c in ROWS[table] if c != "extra_macs"]
    header = "  ".join(c.upper().ljust(w) for c, w in zip(columns, widths, strict=True))
    rule = "  ".join("-" * w for w in widths)
    cells = [f"rpad({_spark(ROWS[table][c])}, {w + 2}, ' ')" for c, w in zip(columns, widths)]
    return header, rule, f"rtrim(concat({', '.join(cells)}))"


def _dump_sql() -> str:
    v = {t: {c: _spark(sql) for c, sql in cols.items()} for t, cols in ROWS.items()}
    parts: list[str] = []

    def put(*texts: str) -> None:
        """Lines of SQL text expressions."""
        parts.extend(texts)

    def say(text: str) -> None:
        put("'" + text.replace("'", "\\'") + "'")

    say("page generated on Mon Feb 09 03:07:41 UTC 2032")
    put("text")
    say("\\nshow_devices:\\nno rule follows this look-alike\\n\\n\\n\\n")
    header, rule, row = _fixed("device", [38, 19, 17, 6, 6, 24, 20, 8])
    say(f" show_devices: \\n{header}\\n{rule}")
    ditto = [f"rpad('\"   \"   \"', 40, ' ') || {x}" for x in EXTRA]
    put(
        _each(
            f"concat({row}, CASE (d + i) % 3 WHEN 0 THEN '' WHEN 1 THEN concat('\\n', {ditto[0]})"
            f" ELSE concat('\\n', {ditto[0]}, '\\n', {ditto[1]}) END)"
        )
    )
    say("not a device row\\n\\n----- bh_report section -----\\nbh_report")
    header, rule, row = _fixed("backhaul", [14, 15, 15, 6, 6, 12, 10, 6, 12])
    say(f"{header}\\n{rule}")
    put(_each(row))
    w = v["wlan_client"]
    say("wlan_report\\nClient  Stat Net Node\\n------- ---- --- ----")
    signal = f"IF({w['rssi']} = '', 'n/a', {w['rssi']})"
    wlan = f"concat_ws('  ', {w['client_mac']}, {w['stat']}, {w['net']}, {w['node']}, {w['mcs']}, {signal}, {w['last_seen']}, 'more')"
    put(_each(wlan))
    say("00:00:00:00:00:00 too short\\n\\ncat /tmp/other\\n{}\\ncat /tmp/msg/DEVINFO/*")
    s = v["node"]
    info = (
        f"concat('{{\"uuid\":\"', {_spark(UUID)}, '\",', '\\n', ' \"data\": {{\"SKU\": \"', {s['sku']}, '\",',"
        f" IF(d % 2 = 0, concat('\"serialNumber\": \"S\\\\\"', n, '}}\",'), ''),"
        f" '\"fw_ver\": \"', IF(d % 3 != 0, concat('2.', d), ''), '\",',"
        f" '\"mode\": \"', {s['mode']}, '\", \"userAp2G_bssid\": \" ', {s['userap2g_bssid']}, ' \",',"
        f" '\"model_base\": \"', {s['model_base']}, '\", \"hw_version\": ', {s['hw_version']}, ',',"
        f" IF(d % 5 != 0, concat('\"model_number\": \"', {s['model_number']}, '\",'), ''),"
        f" '\"userAp2G_channel\": \"', {s['userap2g_channel']}, '\",',"
        # Blank texts count as none.
        f" '\"userAp5GL_bssid\": \"', IF(d % 3 != 1, {s['userap5gl_bssid']}, '  '), '\",',"
        f" '\"userAp5GL_channel\": \"', {s['userap5gl_channel']}, '\",',"
        f" IF(d % 2 = 1, concat('\"userAp5GH_channel\": \"', {s['userap5gh_channel']}, '\",\"userAp5GH_bssid\": \"', {s['userap5gh_bssid']}, '\",'), ''),"
        " '\"list\": [\"{\", {\"a\": \"}\"}]}}')"
    )
    put(
        "array_join(transform(filter(sequence(0, k - 1), i -> "
        f"{HAS_INFO}), i -> concat(IF(i = 1, '{{broken json}}', ''), {info})), ' ')"
    )
    say("cat /tmp/next")
    p = v["ping"]
    first = lambda sql: f"transform(array(0), i -> {sql})[0]"
    put(first(f"concat('--- ', {p['target']}, ' ping statistics ---')"))
    put(
        first(
            f"concat({p['transmitted']}, ' packets transmitted, ', {p['received']}, ' packets received, ',"
            " IF(d % 4 = 0, '100', '0'), '% packet loss',"
            f" IF(d % 4 = 0, '', concat('\\nround-trip min/avg/max = ', d % 90, '.125/', d % 90 + 1, '.25/', d % 90 + 2, '.5 ms')))"
        )
    )
    y = v["ip_neighbor"]
    say("ip neigh:\\n\\nnothing yet")
    put(
        _each(
            f"concat({y['ip']}, ' dev ', {y['iface']}, IF({y['mac']} = '', '', concat(' lladdr ', {y['mac']})),"
            f" IF({ROWS['ip_neighbor']['is_router']}, ' router', ''), IF({y['state']} = '', ' ', concat('  ', {y['state']})))"
        )
    )
    say("\\n10.0.0.1 dev br0 lladdr aa:bb:cc:dd:ee:ff STALE")
    r = v["radio_stats"]
    say("------------- wifi apstats section -------------\\nLost = 1")
    put(
        _each(
            f"concat('radio level information of ', {r['band']}, ':\\nRadio Level Stats: ', {r['radio']},"
            f" '\\nTx Data Bytes = ', {r['tx_data_bytes']}, '\\nRx RSSI = 1\\nRx RSSI = ', {r['rx_rssi']},"
            f" '\\nObss (Chan) Util = ', {r['obss_chan_util']},"
            f" '\\nTx per AC:\\n  Best effort = ', {r['tx_per_ac_best_effort']},"
            f" '\\nRx per AC:\\n  not a pair\\n  Best effort = ', {r['rx_per_ac_best_effort']},"
            f" '\\nNoise dBm = ', {r['noise_dbm']}, '\\n')"
        )
    )
    c = v["radio_config"]
    put(
        _each(
            f"concat('------------- ', {c['interface']}, ' Settings -------------\\nSSID:old\\nSSID: ', {c['ssid']},"
            f" '\\nMac address:', {c['mac']}, '\\nFrequency:', {c['frequency']},"
            f" '\\n get_chwidth:9 g_disablecoext:', {c['disablecoext']}, '\\nget_mode:', {c['mode']}, ' get_chwidth:', {c['chwidth']})"
        )
    )
    say("==== Counters ====\\nNIC Counters")
    n = v["nic_counter"]
    put(
        _each(
            f"concat({n['intf']}, ' : RX bytes:', {n['rx_bytes']}, ' (1.0 GiB)  TX bytes:', {n['tx_bytes']}, ' (2.0 GiB)')"
        )
    )
    y = v["system"]
    put(
        "concat('\\n 10:00:00 up ', CASE WHEN d % 3 = 0 THEN concat(d % 60, ' min')"
        " WHEN d % 3 = 1 THEN concat(d % 24, ':', lpad(d % 60, 2, '0'))"
        " ELSE concat(d % 400, ' days, ', d % 24, ':', lpad(d % 60, 2, '0')) END,"
        " ',  load average: 1.', 10 + d % 90, ', 2.', 10 + d % 80, ', 3.', 10 + d % 70)"
    )
    put(
        first(
            f"concat('Mem:   ', {', '.join(f'''{y[m]}, '  ' ''' for m in y if m.startswith('mem_'))})"
        )
    )
    put(first(f"concat('CPU:   1% usr  ', {y['cpu_idle_pct']}, '% idle   0% io')"))
    say("Mem:  1 2 3 4 5 6\\n==== LLDP Information ====")
    z = v["lldp_neighbor"]
    optional = lambda label, column: f"IF({z[column]} = '', '', concat('    {label}', {z[column]}, '\\n'))"
    put(
        _each(
            f"concat('Interface:    ', {z['interface']}, ', via: LLDP, RID: ', {z['rid']}, ', Time: 1\\n  Chassis:\\n"
            f"    ChassisID:     mac ', {z['chassis_id']}, '\\n', {optional('SysName:   ', 'sys_name')},"
            f" '    SysDescr:     ', {z['sys_descr']}, '\\n', {optional('MgmtIP:   ', 'mgmt_ip')},"
            f" '    Capability:   Bridge, off\\n    Capability:   Bridge, on\\n    Capability:   Station, ',"
            f" IF({z['station']} = 'true', 'on', 'off'),"
            f" '\\n  Port:\\n    PortID:       ', IF(i % 2 = 0, 'mac ', 'ifname '), '\\n    PortID: ', IF(i % 2 = 0, 'mac ', ''), {z['port_id']},"
            f" '\\n    PortDescr:    ', {z['port_descr']})"
        )
    )
    say("====\\nInterface: eth9, via: LLDP, RID: 99")
    return "concat_ws('\\n', " + ",\n".join(parts) + ")"


END = "End of Sysinfo Output"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ``(d, k, n, lang, source, text)``."""
    return source(spark, sf_dir, "documents").selectExpr(
        "doc_id AS d", "1 + doc_id % 5 AS k", "n_chars AS n", "lang", "source", "text"
    )


def as_dump(docs: DataFrame, source_ip: str, text: str) -> DataFrame:
    return docs.selectExpr(
        "'doc' || d AS snapshot_id",
        "timestamp_millis(1959822461000 + d * 600000) AS fetched_at",
        f"{source_ip} AS source_ip",
        f"{text} AS text",
    )


def master_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One complete master dump per document."""
    return as_dump(
        documents(spark, sf_dir), "CAST(NULL AS STRING)", f"concat({_dump_sql()}, '\\n{END}')"
    )


def satellite_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of the second device of every document; with one device alone it is no known node."""
    return as_dump(
        documents(spark, sf_dir),
        f"transform(array(1), i -> {IP})[0]",
        f"concat({_dump_sql()}, '\\n{END}')",
    )


def raw_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document texts as dumps: some broken off, some with text behind the end marker.

    The clock line is missing, unreadable or good in turn.
    """
    clock = (
        "CASE d % 4 WHEN 0 THEN 'no clock' WHEN 1 THEN 'page generated on Monday'"
        " ELSE concat(' Page generated on Mon Feb ', lpad(1 + d % 28, 2, '0'), ' 03:07:', lpad(d % 60, 2, '0'), ' UTC 2032') END"
    )
    tail = f"CASE d % 5 WHEN 0 THEN '' WHEN 1 THEN '{END}\\nbehind' ELSE '{END}' END"
    return as_dump(
        documents(spark, sf_dir),
        "CAST(NULL AS STRING)",
        f"concat_ws('\\n', text, {clock}, 'page generated on Fri Jan 02 00:00:00 UTC 1970', {tail})",
    )
