"""Clock, rate and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Decimal rounding (half up on the decimal text), given back as double."""
    return F.round(value.cast("decimal(38,12)"), digits).cast("double")


def seconds(ms: Column) -> Column:
    return ms / F.lit(1e3)


def mbps(delta_bytes: Column, elapsed_ms: Column) -> Column:
    """Megabits per second of a byte delta, four digits."""
    return rounded(delta_bytes * F.lit(8e0) / seconds(elapsed_ms) / F.lit(1e6), 4)


def percent(part: Column, whole: Column) -> Column:
    """Percentage with three digits; NULL when the whole is zero."""
    return rounded(F.lit(1e2) * part / F.nullif(whole, F.lit(0)), 3)


def whole_number(text: Column) -> Column:
    """A number's text as bigint, a fraction cut off; NULL for any other text."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def in_window(ts: Column, from_ms: int | None, to_ms: int | None) -> Column:
    """Closed millisecond window as a range on the timestamp itself, so scans can prune."""
    test = F.lit(True)
    if from_ms is not None:
        test = test & (ts >= F.timestamp_millis(F.lit(from_ms)))
    if to_ms is not None:
        test = test & (ts < F.timestamp_millis(F.lit(to_ms + 1)))
    return test


def uptime_seconds(days: str, hours: str, mins: str, only_mins: str) -> str:
    """Uptime groups (SQL text) to seconds; either ``H:M`` or minutes alone."""

    def number(group: str) -> str:
        return f"bigint(try_cast({group} AS int))"

    return (
        f"coalesce({number(days)}, 0) * 86400 + coalesce({number(only_mins)} * 60,"
        f" {number(hours)} * 3600 + {number(mins)} * 60)"
    )
