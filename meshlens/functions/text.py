"""Text expressions (SQL text in, SQL text out): lines, cleaning, keys and numbers."""

from __future__ import annotations

from meshlens.functions.arrays import each, let, quoted
from meshlens.sources import formats as fmt


def matches(value: str, pattern: str) -> str:
    return f"{value} RLIKE {quoted(pattern)}"


def hinted(value: str, hint: str, pattern: str) -> str:
    """``matches`` behind a plain search for a text every match contains: most lines lack it."""
    return f"(contains({value}, {quoted(hint)}) AND {value} RLIKE {quoted(pattern)})"


def starts_with(value: str, prefix: str) -> str:
    return f"startswith({value}, {quoted(prefix)})"


def split_lines(text: str) -> str:
    """Lines of a text, any Unicode line break; a final break opens no extra line.

    Splitting at one character takes no regex, so the rare other breaks become that first.
    """
    plain = (
        f"IF({text} RLIKE {quoted(fmt.OTHER_BREAK)},"
        f" regexp_replace({text}, {quoted(fmt.LINE_BREAK)}, '\n'), {text})"
    )
    return let(
        f"split({plain}, '\n')",
        lambda a: f"IF(element_at({a}, -1) = '', slice({a}, 1, size({a}) - 1), {a})",
    )


def strip(value: str) -> str:
    return f"btrim({value}, {quoted(fmt.BLANKS)})"


def is_line(value: str, marker: str) -> str:
    """The line holds ``marker`` and nothing else."""
    return f"(contains({value}, {quoted(marker)}) AND {strip(value)} = {quoted(marker)})"


def not_empty(value: str) -> str:
    return let(value, lambda v: f"IF({v} != '', {v}, NULL)")


def clean(value: str) -> str:
    """Stripped text, NULL when nothing is left."""
    return not_empty(strip(value))


def words(value: str) -> str:
    """White-space separated words."""
    return f"split({strip(value)}, {quoted(fmt.SPACES)})"


def snake(label: str) -> str:
    """Free label to lower-case key with underscores."""
    joined = f"regexp_replace(lower({strip(label)}), {quoted(fmt.NON_WORDS)}, '_')"
    return f"btrim({joined}, '_')"


def behind(value: str, mark: str) -> str:
    """Everything behind the first ``mark`` (one character)."""
    return f"substring({value}, instr({value}, {quoted(mark)}) + 1)"


def host_of(url: str) -> str:
    """Host of a URL in lower case; the empty text when there is none."""
    return f"coalesce(lower(try_parse_url({url}, 'HOST')), '')"


def group(value: str, pattern: str, index: int) -> str:
    """Regex group; NULL when it took no part in the match."""
    return not_empty(f"regexp_extract({value}, {quoted(pattern)}, {index})")


def to_int(value: str, kind: str = "int") -> str:
    """Whole number of ``kind`` (``int`` or ``bigint``); NULL for any other text."""
    return let(
        strip(value),
        lambda v: (
            f"IF({matches(v, fmt.INTEGER_TEXT)}, try_cast(replace({v}, '_') AS {kind}), NULL)"
        ),
    )


def to_float(value: str) -> str:
    """Double; NULL for text that is no number."""
    return let(
        strip(value),
        lambda v: (
            f"CASE WHEN {matches(v, fmt.FLOAT_TEXT)} THEN try_cast(replace({v}, '_') AS double)"
            f" WHEN {matches(v, fmt.SPECIAL_FLOAT_TEXT)} THEN try_cast({v} AS double) END"
        ),
    )


def json_string(value: str) -> str:
    """JSON string literal of a text."""
    return let(
        f"to_json(named_struct('v', {value}))", lambda j: f"substring({j}, 6, length({j}) - 6)"
    )


def json_literal(value: str) -> str:
    """JSON literal of a text: whole number, else finite float, else string."""

    def whole(v: str) -> str:
        digits = f"regexp_replace(translate({v}, '+_', ''), {quoted(fmt.LEADING_ZEROS)}, '$1')"
        return f"regexp_replace({digits}, '^-0$', '0')"

    def decimal(v: str) -> str:
        return let(
            f"try_cast(replace({v}, '_') AS double)",
            lambda x: f"IF(abs({x}) < double('inf'), string({x}), NULL)",
        )

    return let(
        strip(value),
        lambda v: (
            f"coalesce(CASE WHEN {matches(v, fmt.INTEGER_TEXT)} THEN {whole(v)}"
            f" WHEN {matches(v, fmt.FLOAT_TEXT)} THEN {decimal(v)} END, {json_string(v)})"
        ),
    )


def json_object(entries: str) -> str:
    """JSON object of ``(k, v)`` texts whose keys hold word characters only."""
    fields = each(entries, lambda e: f"""concat('"', {e}.k, '": ', {json_literal(f"{e}.v")})""")
    return f"concat('{{', array_join({fields}, ', '), '}}')"
