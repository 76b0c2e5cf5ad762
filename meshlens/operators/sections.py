"""Section isolation inside one dump (an array of lines), as SQL text."""

from __future__ import annotations

from meshlens.functions.arrays import (
    after,
    at,
    each,
    each_with_index,
    first_position,
    keep,
    let,
    positions,
    quoted,
    segments,
    take_while,
    variable,
    when_found,
)
from meshlens.functions.text import clean, is_line, matches, starts_with, strip
from meshlens.sources import formats as fmt


def dashed_table(lines: str, marker: str, row_shape: str) -> str:
    """Rule line and raw rows of a table under a dash rule.

    The table opens at the first line equal to ``marker`` (white space aside) that has a dash
    rule within the next four lines; its rows end at the first line of another shape.
    """

    def rule_below(header: str) -> str:
        near = f"slice({lines}, {header} + 1, {fmt.SEPARATOR_WITHIN})"
        return f"{header} + {first_position(near, lambda x: matches(x, fmt.DASH_ROW))}"

    headers = positions(lines, lambda x: is_line(x, marker))
    rules = f"array_compact({each(headers, rule_below)})"
    return when_found(
        f"get({rules}, 0)",
        lambda rule: (
            f"named_struct('rule', {at(lines, rule)}, 'rows', "
            f"{take_while(after(lines, rule), lambda x: matches(x, row_shape))})"
        ),
    )


def column_starts(rule: str) -> str:
    """1-based start of every dash run of a rule line."""
    return let(
        f"split({rule}, '')",
        lambda chars: "array_compact("
        + each_with_index(
            chars,
            lambda c, i: (
                f"IF({c} = '-' AND coalesce(get({chars}, {i} - 1), ' ') != '-', {i} + 1, NULL)"
            ),
        )
        + ")",
    )


def slice_fixed(row: str, starts: str) -> str:
    """Cells of a fixed-width row: each reaches to the next start, blank cells are NULL."""
    return each_with_index(
        starts,
        lambda p, k: clean(
            f"substring({row}, {p}, coalesce(get({starts}, {k} + 1) - {p}, length({row})))"
        ),
    )


def fixed_width_rows(table: str) -> str:
    """Rows of a :func:`dashed_table` as ``(line, cells)``."""
    return let(
        column_starts(f"{table}.rule"),
        lambda starts: each(
            f"{table}.rows",
            lambda row: f"named_struct('line', {row}, 'cells', {slice_fixed(row, starts)})",
        ),
    )


def opens_section(line: str) -> str:
    """A titled dash line or a banner, the two ways a new section starts."""
    dashed = f"{starts_with(line, fmt.TITLE_PREFIX)} AND {matches(line, fmt.DASH_TITLE)}"
    return f"({dashed} OR {starts_with(line, fmt.BANNER_PREFIX)})"


def titled_section(lines: str, title: str) -> str:
    """Lines from the first ``title`` line to the next section."""
    return when_found(
        first_position(
            lines, lambda x: f"({starts_with(x, fmt.TITLE_PREFIX)} AND {matches(x, title)})"
        ),
        lambda p: take_while(after(lines, p), lambda x: f"NOT {opens_section(x)}"),
    )


def titled_sections(lines: str, title: str) -> str:
    """Every section under a ``title`` line: array of ``(title, body)``."""
    cut = segments(
        positions(lines, opens_section),
        lines,
        lambda p, body: f"named_struct('title', {at(lines, p)}, 'body', {body})",
    )
    return keep(cut, lambda s: matches(f"{s}.title", title))


def blocks(lines: str, opener: str) -> str:
    """Cut lines at every line of shape ``opener``: array of ``(head, body)``."""
    return let(
        lines,
        lambda xs: segments(
            positions(xs, lambda x: matches(strip(x), opener)),
            xs,
            lambda p, body: f"named_struct('head', {strip(at(xs, p))}, 'body', {body})",
        ),
    )


def json_objects(region: str) -> str:
    """Top-level JSON objects of concatenated JSON text, as texts.

    Braces inside strings do not count; a closing brace without its opening one is ignored.
    One pass: the running state grows only when an object closes.
    """
    state, piece = variable(), variable()
    nothing = (
        "named_struct('depth', 0, 'begin', 0, 'at', 0,"
        " 'spans', cast(array() AS array<struct<begin:int,stop:int>>))"
    )
    step = (
        f"named_struct("
        f"'depth', CASE WHEN {piece} = '{{' THEN {state}.depth + 1"
        f" WHEN {piece} = '}}' THEN greatest({state}.depth - 1, 0) ELSE {state}.depth END,"
        f" 'begin', IF({piece} = '{{' AND {state}.depth = 0, {state}.at + 1, {state}.begin),"
        f" 'at', {state}.at + 1,"
        f" 'spans', IF({piece} = '}}' AND {state}.depth = 1,"
        f" concat({state}.spans,"
        f" array(named_struct('begin', {state}.begin, 'stop', {state}.at + 1))),"
        f" {state}.spans))"
    )

    def texts(pieces: str) -> str:
        spans = f"aggregate({pieces}, {nothing}, ({state}, {piece}) -> {step}).spans"
        return each(
            spans,
            lambda s: f"array_join(slice({pieces}, {s}.begin, {s}.stop - {s}.begin + 1), '')",
        )

    return let(f"regexp_extract_all({region}, {quoted(fmt.JSON_PIECE)}, 0)", texts)
