"""Idempotent upsert by ``id`` and additive schema changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evolve(*versions: DataFrame) -> DataFrame:
    """Rows of all versions of a table; a column one of them lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), versions)


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key by ``order``.

    An aggregate rather than a window: copies collapse before the shuffle, so a key that was
    delivered very often costs one row per task.
    """
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return kept.select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns))


def upsert(target: DataFrame, arrivals: DataFrame, key: str = "id") -> DataFrame:
    """``target`` with ``arrivals(.., arrival)`` merged in: the last arrival of a key wins."""
    base = target.withColumn("arrival", F.lit(None).cast("bigint"))
    merged = evolve(base, arrivals).withColumn(
        "arrival", F.coalesce("arrival", F.lit(-1).cast("bigint"))
    )
    return latest_by(merged, [key], "arrival").drop("arrival")
