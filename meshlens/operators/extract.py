"""Extraction of the eleven tables from dumps.

Input: ``dumps(snapshot_id, fetched_at, source_ip, text)``, one row per captured node;
``source_ip`` is NULL for the master. Each section is an expression over the dump's own lines,
so extraction is a projection plus one explode: no shuffle, no state, and the same code runs
on a stream. :func:`sections` computes any choice of sections in a single pass over the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.functions.arrays import (
    after,
    at,
    each,
    each_with_index,
    first_position,
    keep,
    last_match,
    last_per_key,
    let,
    positions,
    quoted,
    segments,
    take_while,
    when_found,
    zipped,
)
from meshlens.functions.macs import family_of, without_id_prefix
from meshlens.functions.measures import uptime_seconds
from meshlens.functions.text import (
    behind,
    clean,
    group,
    hinted,
    is_line,
    json_object,
    matches,
    snake,
    split_lines,
    starts_with,
    strip,
    to_float,
    to_int,
    words,
)
from meshlens.operators.sections import (
    blocks,
    dashed_table,
    fixed_width_rows,
    json_objects,
    titled_section,
    titled_sections,
)
from meshlens.sources import formats as fmt


def struct(**fields: str) -> str:
    """SQL struct of named expressions."""
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _cells(items: str, names: list[str]) -> dict[str, str]:
    return {name: f"get({items}, {k})" for k, name in enumerate(names)}


def device_section(lines: str) -> str:
    """Known hosts; ditto rows add further addresses to the device above them."""
    names = ["uuid", "mac", "ip", "conn", "status", "name", "fw_ver", "role"]

    def is_ditto(row: str) -> str:
        return matches(f"{row}.line", fmt.DITTO_ROW)

    def is_device(row: str) -> str:
        complete = f"size({row}.cells) >= {len(names)} AND get({row}.cells, 0) IS NOT NULL"
        return f"(NOT {is_ditto(row)} AND {complete})"

    def device(row: str, below: str) -> str:
        extra = f"array_compact({each(keep(below, is_ditto), lambda r: f'get({r}.cells, 1)')})"
        return struct(**_cells(f"{row}.cells", names), extra_macs=extra)

    return let(
        dashed_table(lines, fmt.DEVICE_MARKER, fmt.DEVICE_ROW),
        lambda table: let(
            fixed_width_rows(table),
            lambda rows: segments(
                positions(rows, is_device),
                rows,
                lambda p, below: let(at(rows, p), lambda row: device(row, below)),
            ),
        ),
    )


def wlan_section(lines: str) -> str:
    """Associated wireless clients; rows with fewer than seven words are skipped."""
    names = ["client_mac", "stat", "net", "node", "mcs"]
    table = dashed_table(lines, fmt.WLAN_MARKER, fmt.WLAN_ROW)
    return each(
        keep(each(f"{table}.rows", words), lambda w: f"size({w}) >= 7"),
        lambda w: struct(
            **_cells(w, names), rssi=to_int(f"get({w}, 5)"), last_seen=f"get({w}, 6)"
        ),
    )


def backhaul_section(lines: str) -> str:
    """Links between nodes; an empty cell stays NULL and shifts nothing."""
    names = ["node_mac", "node_ip", "parent_ip", "intf", "chan", "rssi"]
    rows = let(
        dashed_table(lines, fmt.BACKHAUL_MARKER, fmt.BACKHAUL_ROW), fixed_width_rows
    )
    return each(
        keep(
            each(rows, lambda r: f"{r}.cells"),
            lambda c: f"size({c}) >= 9 AND get({c}, 0) IS NOT NULL",
        ),
        lambda c: struct(
            **_cells(c, names),
            speed=to_float(f"get({c}, 6)"),
            state=f"get({c}, 7)",
            timestamp=to_int(f"get({c}, 8)", "bigint"),
        ),
    )


def devinfo_section(lines: str) -> str:
    """Node information objects ``(uuid, data)``; broken JSON and other shapes are skipped."""

    def is_marker(x: str) -> str:
        return is_line(x, fmt.DEVINFO_MARKER)

    def region(begin: str) -> str:
        inside = take_while(
            after(lines, begin),
            lambda x: f"({is_marker(x)} OR NOT {starts_with(x, fmt.COMMAND_PREFIX)})",
        )
        # A repeated marker line restarts the region.
        return let(
            inside,
            lambda xs: let(
                f"coalesce(array_max({positions(xs, is_marker)}), 0)",
                lambda last: f"array_join({after(xs, last)}, '\n')",
            ),
        )

    def read(blob: str) -> str:
        return let(
            f"try_parse_json({blob})",
            lambda v: struct(
                uuid=f"try_variant_get({v}, '$.uuid', 'string')",
                data=f"try_variant_get({v}, '$.data', 'variant')",
            ),
        )

    found = when_found(first_position(lines, is_marker), lambda p: json_objects(region(p)))
    return each(
        keep(
            each(found, read),
            lambda o: f"{o}.uuid != '' AND startswith(schema_of_variant({o}.data), 'OBJECT')",
        ),
        lambda o: struct(uuid=f"{o}.uuid", data=f"to_json({o}.data)"),
    )


def node_section(lines: str) -> str:
    """Mesh nodes: devices with a node role, with their information object by exact uuid."""
    roles = ", ".join(quoted(r) for r in fmt.NODE_ROLES)
    keys = [*fmt.DEVINFO_FIELDS.values(), *fmt.DEVINFO_RADIO_FIELDS]
    wanted = ", ".join(f"{key} string" for key in keys)

    def node(device: str, infos: str) -> str:
        matched = last_match(infos, lambda o: f"{o}.uuid = {device}.uuid")

        def row(data: str, info: str) -> str:
            own = {c: f"{device}.{c}" for c in ("uuid", "mac", "ip", "name", "role")}
            fields = {column: f"{info}.{key}" for column, key in fmt.DEVINFO_FIELDS.items()}
            fields["fw_ver"] = f"coalesce(nullif({info}.fw_ver, ''), {device}.fw_ver)"
            radios = {
                key.lower(): clean(f"{info}.{key}") for key in fmt.DEVINFO_RADIO_FIELDS
            }
            return struct(**own, **fields, **radios, devinfo=data)

        return let(
            f"coalesce({matched}.data, '{{}}')",
            lambda data: let(f"from_json({data}, '{wanted}')", lambda info: row(data, info)),
        )

    nodes = keep(device_section(lines), lambda d: f"{d}.role IN ({roles})")
    none = "cast(array() AS array<struct<uuid:string,data:string>>)"
    return let(
        f"coalesce({devinfo_section(lines)}, {none})",
        lambda infos: each(nodes, lambda d: node(d, infos)),
    )


def radio_stats_section(lines: str) -> str:
    """One row per radio with all its counters as a JSON object.

    A line that is not indented leads the indented lines below it; when it is a heading, their
    keys carry the heading as prefix.
    """

    def leads(x: str) -> str:
        return f"{x}.leads"

    def heading_of(leader: str) -> str:
        text = f"{leader}.text"
        return let(
            snake(f"left({text}, length({text}) - 1)"),
            lambda title: (
                f"IF({leads(leader)} AND NOT {hinted(text, '=', fmt.KEY_VALUE)}"
                f" AND endswith({text}, ':') AND {title} != '', concat({title}, '_'), '')"
            ),
        )

    def pairs(run: str, heading: str) -> str:
        return each(
            keep(run, lambda x: hinted(f"{x}.text", "=", fmt.KEY_VALUE)),
            lambda x: struct(
                k=f"concat({heading}, {snake(group(f'{x}.text', fmt.KEY_VALUE, 1))})",
                v=group(f"{x}.text", fmt.KEY_VALUE, 2),
            ),
        )

    def counters(body: str) -> str:
        def led(xs: str) -> str:
            starts = f"array_distinct(concat(array(1), {positions(xs, leads)}))"
            runs = segments(
                starts,
                xs,
                lambda p, run: let(
                    at(xs, p),
                    lambda leader: let(
                        heading_of(leader),
                        lambda heading: pairs(
                            f"array_compact(concat(array({leader}), {run}))", heading
                        ),
                    ),
                ),
            )
            return f"flatten({runs})"

        texts = each(
            body, lambda x: struct(leads=f"left({x}, 1) NOT IN (' ', '\t')", text=strip(x))
        )
        return let(keep(texts, lambda x: f"{x}.text != ''"), led)

    def radios(body: str) -> str:
        marks = positions(
            body,
            lambda x: f"({matches(x, fmt.STATS_BAND)} OR {matches(x, fmt.STATS_RADIO)})",
        )
        marked = segments(
            marks,
            body,
            lambda p, run: struct(
                band=group(at(body, p), fmt.STATS_BAND, 1),
                radio=group(at(body, p), fmt.STATS_RADIO, 1),
                body=run,
            ),
        )

        def radio(ms: str, m: str, k: str) -> str:
            carried = last_match(f"slice({ms}, 1, {k} + 1)", lambda b: f"{b}.band IS NOT NULL")
            stats = json_object(last_per_key(counters(f"{m}.body")))
            return struct(
                radio=f"{m}.radio",
                band=f"{carried}.band",
                stats=f"IF({m}.band IS NULL, {stats}, NULL)",
            )

        return let(
            marked,
            lambda ms: keep(
                each_with_index(ms, lambda m, k: radio(ms, m, k)),
                lambda r: f"{r}.stats IS NOT NULL",
            ),
        )

    return let(titled_section(lines, fmt.STATS_TITLE), radios)


def radio_config_section(lines: str) -> str:
    """One row per access-point interface with all its setting tokens as a JSON object."""

    def last_value(body: str, prefix: str) -> str:
        return let(
            last_match(body, lambda x: starts_with(x, prefix)),
            lambda line: clean(behind(line, ":")),
        )

    def settings(body: str) -> str:
        token = quoted(fmt.CONFIG_TOKEN)
        return let(
            f"array_join({body}, '\n')",
            lambda text: zipped(
                f"regexp_extract_all({text}, {token}, 1)",
                f"regexp_extract_all({text}, {token}, 2)",
            ),
        )

    return each(
        titled_sections(lines, fmt.CONFIG_TITLE),
        lambda s: struct(
            interface=group(f"{s}.title", fmt.CONFIG_TITLE, 1),
            ssid=last_value(f"{s}.body", fmt.CONFIG_SSID),
            mac=last_value(f"{s}.body", fmt.CONFIG_MAC),
            frequency=last_value(f"{s}.body", fmt.CONFIG_FREQUENCY),
            settings=json_object(last_per_key(settings(f"{s}.body"))),
        ),
    )


def nic_section(lines: str) -> str:
    """Interface byte counters directly below the marker."""
    rows = when_found(
        first_position(lines, lambda x: is_line(x, fmt.NIC_MARKER)),
        lambda p: take_while(after(lines, p), lambda x: matches(x, fmt.NIC_ROW)),
    )
    return each(
        rows,
        lambda x: struct(
            intf=group(x, fmt.NIC_ROW, 1),
            rx_bytes=to_int(group(x, fmt.NIC_ROW, 2), "bigint"),
            tx_bytes=to_int(group(x, fmt.NIC_ROW, 3), "bigint"),
        ),
    )


def neighbor_section(lines: str) -> str:
    """Neighbour table; anything between the marker and the first row is skipped."""

    def is_row(x: str) -> str:
        return hinted(x, fmt.NEIGHBOR_HINT, fmt.NEIGHBOR_ROW)

    def rows_in(below: str) -> str:
        return when_found(
            first_position(below, is_row),
            lambda p: take_while(after(below, f"{p} - 1"), is_row),
        )

    def neighbor(x: str, ip: str) -> str:
        flags = words(f"regexp_extract({x}, {quoted(fmt.NEIGHBOR_ROW)}, 4)")
        return struct(
            ip=ip,
            family=family_of(ip),
            iface=group(x, fmt.NEIGHBOR_ROW, 2),
            mac=group(x, fmt.NEIGHBOR_ROW, 3),
            is_router=f"array_contains({flags}, {quoted(fmt.NEIGHBOR_ROUTER_FLAG)})",
            state=group(x, fmt.NEIGHBOR_ROW, 5),
        )

    rows = when_found(
        first_position(lines, lambda x: is_line(x, fmt.NEIGHBOR_MARKER)),
        lambda p: let(after(lines, p), rows_in),
    )
    return each(
        rows, lambda x: let(group(x, fmt.NEIGHBOR_ROW, 1), lambda ip: neighbor(x, ip))
    )


def ping_section(lines: str) -> str:
    """Reachability probe: the first header and the four lines below it."""

    def probe(head: str, near: str) -> str:
        hit = struct(
            counts=last_match(near, lambda x: matches(x, fmt.PING_COUNTS)),
            times=last_match(near, lambda x: matches(x, fmt.PING_TIMES)),
        )
        return let(
            hit,
            lambda h: "array("
            + struct(
                target=group(strip(head), fmt.PING_TITLE, 1),
                transmitted=to_int(group(f"{h}.counts", fmt.PING_COUNTS, 1)),
                received=to_int(group(f"{h}.counts", fmt.PING_COUNTS, 2)),
                loss_pct=to_float(group(f"{h}.counts", fmt.PING_COUNTS, 3)),
                rtt_min=to_float(group(f"{h}.times", fmt.PING_TIMES, 1)),
                rtt_avg=to_float(group(f"{h}.times", fmt.PING_TIMES, 2)),
                rtt_max=to_float(group(f"{h}.times", fmt.PING_TIMES, 3)),
            )
            + ")",
        )

    return when_found(
        first_position(
            lines,
            lambda x: (
                f"(contains({x}, {quoted(fmt.PING_HINT)}) AND {matches(strip(x), fmt.PING_TITLE)})"
            ),
        ),
        lambda p: probe(at(lines, p), f"slice({lines}, {p} + 1, {fmt.PING_WITHIN})"),
    )


def system_section(lines: str) -> str:
    """Health figures from wherever they stand; one row, none when nothing is found."""
    memory = ["mem_total", "mem_used", "mem_free", "mem_shared", "mem_buffers", "mem_cached"]
    loads = ["load_1", "load_5", "load_15"]

    def first_of(hint: str, pattern: str) -> str:
        return f"get({keep(lines, lambda x: hinted(x, hint, pattern))}, 0)"

    def first_readable(hint: str, pattern: str) -> str:
        # The first match whose leading figure is a number; failing that, the last match.
        return let(
            keep(lines, lambda x: hinted(x, hint, pattern)),
            lambda xs: (
                "coalesce(get("
                + keep(xs, lambda x: f"{to_float(group(x, pattern, 1))} IS NOT NULL")
                + f", 0), try_element_at({xs}, -1))"
            ),
        )

    def row(hit: str) -> str:
        figures = struct(
            uptime_secs=uptime_seconds(
                *(group(f"{hit}.up", fmt.UPTIME, k) for k in (1, 2, 3, 4))
            ),
            **{
                name: to_float(group(f"{hit}.load", fmt.LOAD_AVERAGE, k))
                for k, name in enumerate(loads, 1)
            },
            **{
                name: to_int(group(f"{hit}.mem", fmt.MEMORY, k), "bigint")
                for k, name in enumerate(memory, 1)
            },
            cpu_idle_pct=to_float(group(f"{hit}.cpu", fmt.CPU_IDLE, 1)),
        )
        anything = f"coalesce({hit}.up, {hit}.load, {hit}.mem, {hit}.cpu) IS NOT NULL"
        return f"IF({anything}, array({figures}), NULL)"

    return let(
        struct(
            up=first_of(fmt.UPTIME_HINT, fmt.UPTIME),
            load=first_readable(fmt.LOAD_HINT, fmt.LOAD_AVERAGE),
            mem=first_of(fmt.MEMORY_HINT, fmt.MEMORY),
            cpu=first_readable(fmt.CPU_HINT, fmt.CPU_IDLE),
        ),
        row,
    )


def lldp_section(lines: str) -> str:
    """Link-layer neighbours; a field printed twice keeps its last value."""

    def last_value(body: str, prefix: str) -> str:
        return let(
            last_match(body, lambda x: starts_with(x, prefix)), lambda line: behind(line, ":")
        )

    def capability(token: str) -> str:
        state = f"lower({strip(behind(token, ','))}) = {quoted(fmt.LLDP_ENABLED)}"
        return struct(
            k=clean(f"substring_index({token}, ',', 1)"),
            v=f"contains({token}, ',') AND {state}",
        )

    def capabilities(body: str) -> str:
        tokens = each(
            keep(body, lambda x: starts_with(x, fmt.LLDP_CAPABILITY)), lambda x: behind(x, ":")
        )
        named = keep(each(tokens, capability), lambda e: f"{e}.k IS NOT NULL")
        entries = each(last_per_key(named), lambda e: struct(key=f"{e}.k", value=f"{e}.v"))
        return f"to_json(map_from_entries({entries}))"

    def neighbor(head: str, body: str) -> str:
        return struct(
            interface=clean(group(head, fmt.LLDP_NEIGHBOR, 1)),
            rid=group(head, fmt.LLDP_NEIGHBOR, 2),
            chassis_id=without_id_prefix(last_value(body, fmt.LLDP_CHASSIS)),
            sys_name=clean(last_value(body, fmt.LLDP_SYS_NAME)),
            sys_descr=clean(last_value(body, fmt.LLDP_SYS_DESCR)),
            mgmt_ip=clean(last_value(body, fmt.LLDP_MGMT_IP)),
            port_id=without_id_prefix(last_value(body, fmt.LLDP_PORT)),
            port_descr=clean(last_value(body, fmt.LLDP_PORT_DESCR)),
            capabilities=capabilities(body),
        )

    region = when_found(
        first_position(lines, lambda x: hinted(x, fmt.LLDP_HINT, fmt.LLDP_TITLE)),
        lambda p: take_while(
            after(lines, p), lambda x: f"NOT {starts_with(x, fmt.BANNER_PREFIX)}"
        ),
    )
    return each(
        blocks(region, fmt.LLDP_NEIGHBOR),
        lambda b: let(each(f"{b}.body", strip), lambda body: neighbor(f"{b}.head", body)),
    )


SECTIONS: dict[str, Callable[[str], str]] = {
    "device": device_section,
    "wlan_client": wlan_section,
    "backhaul": backhaul_section,
    "ping": ping_section,
    "node": node_section,
    "radio_stats": radio_stats_section,
    "radio_config": radio_config_section,
    "nic_counter": nic_section,
    "system": system_section,
    "ip_neighbor": neighbor_section,
    "lldp_neighbor": lldp_section,
}
# Tables that every node's dump feeds; the others come from the master's dump alone.
PER_NODE = ("radio_stats", "system")


@cache
def section_sql(table: str) -> str:
    """Expression over ``source_ip`` and ``lines`` that gives a table's rows as an array."""
    rows = SECTIONS[table]("lines")
    return rows if table in PER_NODE else f"IF(source_ip IS NULL, {rows}, NULL)"


def with_lines(dumps: DataFrame) -> DataFrame:
    """Dumps with their text cut into ``lines``.

    The one-element explode keeps the lines a column of their own: were they a plain
    projection, a filter pushed through it would cut the text again for every line.
    """
    lines = F.explode(F.array(F.expr(split_lines("text")))).alias("lines")
    return dumps.select("snapshot_id", "fetched_at", "source_ip", lines)


def sections(dumps: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """Chosen sections of every dump as arrays of rows, all in one pass over the text."""
    # Of a key that an information object repeats, the last value counts.
    dumps.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return with_lines(dumps).select(
        "snapshot_id",
        "fetched_at",
        "source_ip",
        *(F.expr(section_sql(t)).alias(t) for t in tables or SECTIONS),
    )


def section_rows(extracted: DataFrame, table: str) -> DataFrame:
    """Rows of one section with their position in it.

    The outer explode spares a test for empty sections that would compute them twice.
    """
    return (
        extracted.select(
            "snapshot_id",
            "fetched_at",
            "source_ip",
            F.posexplode_outer(table).alias("pos", "row"),
        )
        .where("pos IS NOT NULL")
        .select("snapshot_id", "fetched_at", "source_ip", "pos", "row.*")
    )


def extract(dumps: DataFrame, table: str) -> DataFrame:
    """Rows of one table from all dumps."""
    return section_rows(sections(dumps, [table]), table)
