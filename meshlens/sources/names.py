"""Device-name payloads: one JSON document per snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions.arrays import let

# The shape of the payload. Lists are read as raw JSON first, so that an element
# of another shape spoils only itself.
PAYLOAD = "result string, output struct<devices:array<string>>"
DEVICE = "deviceID string, friendlyName string, knownInterfaces array<string>"
ACCEPTED = "OK"


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """``(snapshot_id, payload)`` to ``(snapshot_id, devices)``; only accepted answers.

    A device is ``(id, name, macs)``, NULL where an entry is no object.
    """
    parsed = payloads.select("snapshot_id", F.from_json("payload", PAYLOAD).alias("p"))
    device = let(
        f"from_json(d, '{DEVICE}')",
        lambda v: (
            f"named_struct('id', {v}.deviceID, 'name', {v}.friendlyName, 'macs',"
            f" transform({v}.knownInterfaces, i -> get_json_object(i, '$.macAddress')))"
        ),
    )
    return parsed.where(F.col("p.result") == ACCEPTED).select(
        "snapshot_id", F.expr(f"transform(p.output.devices, d -> {device})").alias("devices")
    )


def read_payloads(spark: SparkSession, root: str) -> DataFrame:
    """Landed payload files ``<root>/<snapshot id>.json``."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.json$", 1)
    files = spark.read.text(f"{root}/*.json", wholetext=True)
    return parse_payloads(files.select(name.alias("snapshot_id"), F.col("value").alias("payload")))
