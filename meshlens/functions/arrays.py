"""Small building blocks over arrays, as Spark SQL text.

A dump is one row, so its sections are cut with array expressions inside that row: no line of
a dump is ever shuffled. The expressions are long, so they are put together as SQL text and
handed to Spark in one piece. ``let`` binds a computed value once; without it Spark would
evaluate the expression again for every element of a lambda that mentions it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_numbers = count()

Body = Callable[[str], str]


def quoted(text: str) -> str:
    """SQL string literal; raw, so patterns keep their backslashes."""
    if "'" in text:
        raise ValueError(f"cannot quote {text!r}")
    return f"r'{text}'" if "\\" in text else f"'{text}'"


def variable() -> str:
    """A lambda variable name not used before."""
    return f"v{next(_numbers)}"


def let(value: str, body: Body) -> str:
    """``body(value)`` with ``value`` evaluated once."""
    v = variable()
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def each(items: str, body: Body) -> str:
    v = variable()
    return f"transform({items}, {v} -> {body(v)})"


def each_with_index(items: str, body: Callable[[str, str], str]) -> str:
    """``body(element, 0-based index)``."""
    v, i = variable(), variable()
    return f"transform({items}, ({v}, {i}) -> {body(v, i)})"


def keep(items: str, test: Body) -> str:
    v = variable()
    return f"filter({items}, {v} -> {test(v)})"


def positions(items: str, test: Body) -> str:
    """1-based positions of the elements that pass ``test``, ascending."""
    marked = each_with_index(items, lambda x, i: f"IF({test(x)}, {i} + 1, NULL)")
    return f"array_compact({marked})"


def first_position(items: str, test: Body) -> str:
    """1-based position of the first element that passes ``test``; NULL when there is none."""
    found = f"int(array_position({each(items, test)}, true))"
    return let(found, lambda p: f"IF({p} > 0, {p}, NULL)")


def when_found(position: str, body: Body) -> str:
    """``body(position)``, NULL when the position is."""
    return let(position, lambda p: f"IF({p} IS NOT NULL, {body(p)}, NULL)")


def at(items: str, position: str) -> str:
    """Element at a 1-based position; NULL outside."""
    return f"get({items}, {position} - 1)"


def after(items: str, position: str) -> str:
    """Elements behind the 1-based ``position``."""
    return f"slice({items}, {position} + 1, size({items}))"


def between(items: str, start: str, stop: str) -> str:
    """Elements strictly between two 1-based positions; ``stop`` NULL means to the end."""
    return f"slice({items}, {start} + 1, coalesce({stop} - {start} - 1, size({items})))"


def take_while(items: str, test: Body) -> str:
    """Leading elements up to, not including, the first that fails ``test``."""
    return let(
        items,
        lambda xs: let(
            first_position(xs, lambda x: f"NOT ({test(x)})"),
            lambda p: f"IF({p} IS NULL, {xs}, slice({xs}, 1, {p} - 1))",
        ),
    )


def segments(starts: str, items: str, body: Callable[[str, str], str]) -> str:
    """Cut ``items`` at the 1-based ``starts``: ``body(start, elements up to the next start)``."""
    return let(
        starts,
        lambda ps: each_with_index(
            ps, lambda p, k: body(p, between(items, p, f"get({ps}, {k} + 1)"))
        ),
    )


def last_match(items: str, test: Body) -> str:
    """Last element that passes ``test``; NULL when there is none."""
    return f"try_element_at({keep(items, test)}, -1)"


def zipped(keys: str, values: str) -> str:
    """Structs ``(k, v)`` of two arrays of equal length."""
    return let(
        values,
        lambda vs: each_with_index(
            keys, lambda k, i: f"named_struct('k', {k}, 'v', get({vs}, {i}))"
        ),
    )


def last_per_key(entries: str) -> str:
    """Keep the last of the entries with equal ``k`` in an array of structs ``(k, v)``."""
    ordered = each_with_index(
        entries, lambda e, i: f"named_struct('k', {e}.k, 'i', {i}, 'v', {e}.v)"
    )

    def closing(xs: str) -> str:
        e, i = variable(), variable()
        return f"filter({xs}, ({e}, {i}) -> NOT (get({xs}, {i} + 1).k <=> {e}.k))"

    return let(f"array_sort({ordered})", closing)
