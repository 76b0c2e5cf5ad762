"""Hardware-address expressions (SQL text in, SQL text out)."""

from __future__ import annotations

from meshlens.functions.arrays import let, quoted
from meshlens.functions.text import clean, strip
from meshlens.sources import formats as fmt


def hex_digits(value: str) -> str:
    """Hex digits of a text in lower case; an absent value gives the empty text."""
    return f"lower(regexp_replace(coalesce({value}, ''), '[^0-9a-fA-F]+', ''))"


def oui_of(mac: str) -> str:
    """24-bit prefix as ``AA:BB:CC``; NULL with fewer than six hex digits."""
    return let(
        f"upper({hex_digits(mac)})",
        lambda h: (
            f"IF(length({h}) >= 6, concat_ws(':', left({h}, 2), substring({h}, 3, 2),"
            f" substring({h}, 5, 2)), NULL)"
        ),
    )


def without_id_prefix(value: str) -> str:
    """Identifier without its leading type word; NULL when nothing is left."""
    size = len(fmt.LLDP_ID_PREFIX)
    return let(
        strip(value),
        lambda v: clean(
            f"IF(lower(left({v}, {size})) = {quoted(fmt.LLDP_ID_PREFIX)},"
            f" substring({v}, {size + 1}), {v})"
        ),
    )


def family_of(ip: str) -> str:
    return f"IF(contains({ip}, ':'), 'inet6', 'inet')"
