"""Keyed messages: one topic per table, keyed by snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.sources import formats as fmt
from meshlens.sources.tables import ADDED, avro_schema, conform, schema

DEFAULT_PREFIX = "mesh."


def topic_of(table: str, prefix: str = DEFAULT_PREFIX) -> str:
    return f"{prefix}{table}"


def table_of(prefix: str = DEFAULT_PREFIX):
    """Table behind a ``topic`` column; NULL for a topic of another prefix."""
    topic = F.col("topic")
    return F.when(topic.startswith(prefix), F.substr(topic, F.lit(len(prefix) + 1)))


def messages(
    rows: DataFrame, table: str, prefix: str = DEFAULT_PREFIX, marked_time: bool = False
) -> DataFrame:
    """``(topic, key, value)`` of a table's rows, the value as JSON with every declared field.

    Objects travel as JSON text, arrays as arrays, NULL as null. The capture time is epoch
    milliseconds; ``marked_time`` wraps it so that a buffer can tell it from a number.
    """
    ms = F.unix_millis("fetched_at")
    at = F.struct(ms.alias(fmt.BUFFER_TIME_KEY)) if marked_time else ms
    fields = [at.alias(f) if f == "fetched_at" else F.col(f"`{f}`") for f in schema(table).names]
    value = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return conform(rows, table).select(
        F.lit(topic_of(table, prefix)).alias("topic"),
        F.col("snapshot_id").alias("key"),
        value.alias("value"),
    )


def avro_messages(rows: DataFrame, table: str, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """The same with Avro values; needs Spark's Avro package on the cluster."""
    from pyspark.sql.avro.functions import to_avro

    declared = conform(rows, table)
    value = to_avro(F.struct(*declared.columns), avro_schema(table))
    return declared.select(
        F.lit(topic_of(table, prefix)).alias("topic"),
        F.col("snapshot_id").alias("key"),
        value.alias("value"),
    )


def all_messages(
    tables: dict[str, DataFrame], prefix: str = DEFAULT_PREFIX, marked_time: bool = False
) -> DataFrame:
    """Messages of several tables; an empty table adds nothing."""
    parts = [messages(rows, t, prefix, marked_time) for t, rows in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def message_counts(sent: DataFrame) -> DataFrame:
    return sent.groupBy("topic").agg(F.count("*").alias("messages"))


def parse_messages(
    sent: DataFrame, table: str, prefix: str = DEFAULT_PREFIX, whole: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows of one table's messages, and its unreadable messages as dead letters.

    Takes both spellings of the capture time. A message is unreadable when its value is no
    JSON of the declared shape or lacks one of the three leading fields. ``whole`` adds what
    the declared columns do not hold: ``added``, a map of further fields, and ``arrival``, the
    place of the message among those of its batch.
    """
    fields = [
        f"`{f.name}` string" if f.name == "fetched_at" else f"`{f.name}` {f.dataType.simpleString()}"
        for f in schema(table)
    ]
    own = sent.where(F.col("topic") == topic_of(table, prefix))
    read = own.select(
        "topic",
        "key",
        "value",
        (F.col("arrival") if "arrival" in sent.columns else F.lit("")).alias("arrival"),
        F.from_json(
            "value",
            ", ".join([*fields, "_bad string"]),
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
        ).alias("r"),
    )
    ms = F.coalesce(
        F.get_json_object("r.fetched_at", f"$.{fmt.BUFFER_TIME_KEY}"), F.col("r.fetched_at")
    ).try_cast("bigint")
    timed = read.withColumn("at", F.timestamp_millis(ms))
    good = F.expr(
        "r._bad IS NULL AND r.id IS NOT NULL AND r.snapshot_id IS NOT NULL AND at IS NOT NULL"
    )
    kept = timed.where(good)
    rows = kept.select("r.*", "at").drop("_bad", "fetched_at")
    if whole:
        rows = kept.select("r.*", "at", "arrival", _further("value", table)).drop("_bad", "fetched_at")
    dead = timed.where(~F.coalesce(good, F.lit(False))).select("topic", "key", "value")
    rows = rows.withColumnRenamed("at", "fetched_at")
    return conform(rows, table, ["arrival", ADDED] if whole else []), dead


def _further(value: str, table: str):
    """Fields of a message beyond the declared ones, as text by name; NULL without any."""
    fields = F.from_json(value, "map<string,string>")
    further = F.map_filter(fields, lambda k, _: ~k.isin(*schema(table).names))
    return F.when(F.size(further) > 0, further).alias(ADDED)


def write_kafka(sent: DataFrame, servers: str) -> None:
    """Deliver messages to a broker; needs Spark's Kafka package on the cluster."""
    sent.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
