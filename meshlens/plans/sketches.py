"""Distinct hosts over any span of time, from sketches of every snapshot.

Exact distinct counts can't be added up: a day's hosts are not the sum of its snapshots' hosts. A
HyperLogLog sketch per snapshot and subnet can be stored once and merged to hours, days or
weeks later, without the neighbour rows. The exact form (V2) stays the default for snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.plans.views import IPV4, subnet_of

#: Registers of a sketch, as a power of two; three standard errors of it.
BITS = 12
ERROR = 3 * 1.04 / 2 ** (BITS / 2)


def neighbor_sketches(ip_neighbor: DataFrame) -> DataFrame:
    """``(fetched_at, subnet, hosts)``: of every snapshot and subnet a sketch of its hosts' addresses.

    As in the exact counts, IPv4 alone counts, addresses keep their case, and unresolved hosts are none.
    """
    return (
        ip_neighbor.where(F.col("family") == IPV4)
        .groupBy("fetched_at", subnet_of().alias("subnet"))
        .agg(F.hll_sketch_agg("mac", F.lit(BITS)).alias("hosts"))
    )


def merged(sketches: DataFrame, unit: str) -> DataFrame:
    """``(span, subnet, hosts)``: the sketches of a unit of time (``'hour'``, ``'day'``, ``'week'``) as one."""
    return sketches.groupBy(F.date_trunc(unit, "fetched_at").alias("span"), "subnet").agg(
        F.hll_union_agg("hosts").alias("hosts")
    )


def live_hosts(sketches: DataFrame, unit: str) -> DataFrame:
    """``(span, subnet, live_hosts)``: estimated distinct hosts, within ``ERROR`` of the exact number."""
    return merged(sketches, unit).select("span", "subnet", F.hll_sketch_estimate("hosts").alias("live_hosts"))
