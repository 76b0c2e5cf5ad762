"""Table lake on plain parquet, and the shared scratch folder.

One layout for every way in: ``<root>/<table>/day=<capture day>/writer=<id>/batch=<n>``. A writer
is one stream checkpoint or one batch run, so no writer can touch another's rows, and a batch that
is run again replaces exactly its own earlier attempt. Rows are versions: an id that is delivered
again is stored again, and the reader gives the version that arrived last. ``compact`` rewrites a
day to one version per id; a day that lies in one batch is read as it is, without looking for versions.

What arrived last is told by a number that a batch gets at its first attempt and keeps when it is
run again; it grows from batch to batch of a writer whatever the clock does.

Beside the counter tables lies an index, ``<root>/_last/<table>``: per entity and day the rows of its
last time. It is written with every batch and by ``compact``. A rate over a window needs, of the time
before the window, only an entity's last rows: ``read_series`` takes them from the index, so that no
day before the window's first one is read, however long the history is.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from datetime import date, datetime, timedelta, timezone
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions.measures import in_window
from meshlens.operators.upsert import latest_by
from meshlens.sources.files import Folder
from meshlens.sources.tables import ADDED, schema

#: Stored beside a table's own columns.
STAMPS = f"`{ADDED}` map<string, string>, pos int, source_ip string, arrived_ms bigint, arrival string, moved boolean"
PLACES = "day date, writer string, batch bigint"
#: Of longer windows all days are searched for versions.
MOST_DAYS_LISTED = 400
#: Tables of counters, and what tells their series apart.
ENTITIES = {"radio_stats": ["source_node_mac", "band", "radio"], "nic_counter": ["intf"]}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="meshlens-")
    return f"{base}/{purpose}-{uuid.uuid4().hex}"


def stream_id(batch: DataFrame) -> str | None:
    """Id of the stream query that runs this micro-batch; it stays with its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def new_writer() -> str:
    return uuid.uuid4().hex


def ddl(table: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema(table))


def arrival_number(spark: SparkSession, root: str, table: str, writer: str, batch_id: int) -> int:
    """The number of a writer's batch: given at its first attempt, and greater than that of the batch before.

    It is kept as the name of an empty file, so a crash leaves either no number or the whole one.
    """

    folder = Folder(spark, f"{root}/_arrivals/{table}/{writer}")

    def numbers(batch: int) -> list[int]:
        return [int(name.rsplit("/", 1)[1]) for name in folder.names(str(batch))]

    if own := numbers(batch_id):
        return min(own)
    number = max([time.time_ns() // 1_000_000, *(n + 1 for n in numbers(batch_id - 1))])
    folder.touch(f"{batch_id}/{number}")
    return number


def store_rows(rows: DataFrame, root: str, table: str, writer: str, batch_id: int = 0) -> None:
    """Store one batch's rows, an id once; the same batch of the same writer replaces its earlier attempt.

    ``moved`` marks rows that were stored before as rows of another entity.
    """
    have = set(rows.columns)
    stamps = [
        F.col(ADDED) if ADDED in have else F.lit(None).cast("map<string,string>").alias(ADDED),
        F.col("pos").cast("int") if "pos" in have else F.lit(None).cast("int").alias("pos"),
        F.col("source_ip") if "source_ip" in have else F.lit(None).cast("string").alias("source_ip"),
        F.lit(arrival_number(rows.sparkSession, root, table, writer, batch_id)).alias("arrived_ms"),
        F.col("arrival") if "arrival" in have else F.lit("").alias("arrival"),
        F.col("moved") if "moved" in have else F.lit(False).alias("moved"),
    ]
    placed = rows.select(
        *schema(table).names,
        *stamps,
        F.to_date("fetched_at").alias("day"),
        F.lit(writer).alias("writer"),
        F.lit(batch_id).cast("bigint").alias("batch"),
    )
    _place(placed.hint("rebalance", "day"), f"{root}/{table}")  # few files a day, and no hot day in one task
    if table in ENTITIES:
        index_batch(rows.sparkSession, root, table, writer, batch_id, moved="moved" in have)


def _place(rows: DataFrame, folder: str) -> None:
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "writer", "batch")
        .parquet(folder)
    )


def last_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """All rows at the last time of every ``by``; NULL is a value of its own here."""
    last = rows.groupBy(*by).agg(F.max("fetched_at").alias("_at"))
    last = last.select("_at", *(F.col(c).alias(f"_{c}") for c in by))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(last, reduce(and_, same, F.col("fetched_at") == F.col("_at")), "left_semi")


def index_batch(
    spark: SparkSession, root: str, table: str, writer: str, batch_id: int, moved: bool = False
) -> None:
    """Index what a batch has stored: per entity and day the rows of its last time there.

    Where rows have moved to another entity, the last row of the one they left lies in some older
    batch: of such a day the index takes the last rows of all batches.
    """
    by = [*ENTITIES[table], "day"]
    try:
        own = _stored(spark, f"{root}/{table}", table, f"day=*/writer={writer}/batch={batch_id}")
    except AnalysisException:
        return  # nothing stored
    rows = last_rows(own, by)
    days = [r.day for r in own.where("moved").select("day").distinct().collect()] if moved else []
    if days:
        whole = newest(versions(spark, root, table).where(F.col("day").isin(days)))
        whole = whole.withColumn("writer", F.lit(writer)).withColumn("batch", F.lit(batch_id).cast("bigint"))
        rows = rows.where(~F.col("day").isin(days)).unionByName(last_rows(whole, by))
        rows = rows.unionByName(own.where("moved")).dropDuplicates(["id", "arrived_ms"])
    _place(rows.hint("rebalance", "day"), f"{root}/_last/{table}")


def _stored(spark: SparkSession, folder: str, table: str, part: str = "") -> DataFrame:
    reader = spark.read.schema(f"{ddl(table)}, {STAMPS}, {PLACES}")
    return reader.option("basePath", folder).parquet(f"{folder}/{part}" if part else folder)


def versions(
    spark: SparkSession,
    root: str,
    table: str,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    """All stored versions of a table's rows; a time window reads only its days."""
    return _days_of(spark, f"{root}/{table}", table, from_ms, to_ms)


def _days_of(spark: SparkSession, folder: str, table: str, from_ms: int | None, to_ms: int | None) -> DataFrame:
    try:
        stored = _stored(spark, folder, table)
    except AnalysisException:
        return spark.createDataFrame([], f"{ddl(table)}, {STAMPS}, {PLACES}")
    if from_ms is not None:
        stored = stored.where(F.col("day") >= F.to_date(F.timestamp_millis(F.lit(from_ms))))
    if to_ms is not None:
        stored = stored.where(F.col("day") <= F.to_date(F.timestamp_millis(F.lit(to_ms))))
    return stored


def newest(stored: DataFrame) -> DataFrame:
    """Of every id the version that arrived last."""
    order = F.struct("arrived_ms", "writer", "batch", "arrival")
    return latest_by(stored.withColumn("_order", order), ["id"], "_order").drop("_order")


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    from_ms: int | None = None,
    to_ms: int | None = None,
    added: dict[str, str] | None = None,
) -> DataFrame:
    """A stored table: of every id the version that arrived last.

    With a time window only the days it touches are read; an id keeps its capture time, as a
    snapshot does, when it is delivered again. Days of the window that lie in one batch hold an id
    once and are not searched for versions. ``added`` names columns (and their types) that arrived
    beyond the declared ones; rows without one give NULL.
    """
    stored = versions(spark, root, table, from_ms, to_ms)
    bounded = from_ms is not None and to_ms is not None
    several = days_of_several_batches(spark, root, table, from_ms, to_ms) if bounded else None
    if several is None:
        rows = newest(stored)
    else:
        again = F.col("day").isin(several) if several else F.lit(False)
        rows = stored.where(~again)
        rows = rows.unionByName(newest(stored.where(again))) if several else rows
    extra = [F.col(ADDED)[c].try_cast(kind).alias(c) for c, kind in (added or {}).items()]
    return rows.select(*schema(table).names, *extra)


def store_waiting(spark: SparkSession, root: str, table: str, writer: str, batch_id: int) -> None:
    """Keep a batch's rows without a source node aside, for the batch that their master comes with."""
    try:
        own = _stored(spark, f"{root}/{table}", table, f"day=*/writer={writer}/batch={batch_id}")
    except AnalysisException:
        return  # nothing stored
    _place(own.where("source_node_mac IS NULL").hint("rebalance", "day"), f"{root}/_waiting/{table}")


def waiting_rows(
    spark: SparkSession, root: str, table: str, from_ms: int, to_ms: int, which: Column | None = None
) -> DataFrame:
    """Rows kept aside on the days of a time window, each id once."""
    aside = _days_of(spark, f"{root}/_waiting/{table}", table, from_ms, to_ms)
    return newest(aside if which is None else aside.where(which))


def drop_waiting(spark: SparkSession, root: str, before: date) -> None:
    """Forget rows kept aside of the days before one; their masters are not expected any more."""
    for name in Folder(spark, f"{root}/_waiting").folders("*/day=*"):
        if name.rsplit("=", 1)[1] < before.isoformat():
            remove(spark, f"{root}/_waiting/{name}")


def days_of_several_batches(spark: SparkSession, root: str, table: str, from_ms: int, to_ms: int) -> list[date] | None:
    """Days of a window that are stored in more than one batch, by the names of their folders.

    None for a window too long to look at its days one by one.
    """
    first, last = (datetime.fromtimestamp(ms / 1000, timezone.utc).date() for ms in (from_ms, to_ms))
    if (last - first).days >= MOST_DAYS_LISTED:
        return None
    folder = Folder(spark, f"{root}/{table}")
    days = [first + timedelta(days=k) for k in range((last - first).days + 1)]
    return [d for d in days if folder.matches(f"day={d}/writer=*/batch=*") > 1]


def read_series(
    spark: SparkSession, root: str, table: str, from_ms: int | None = None, to_ms: int | None = None
) -> DataFrame:
    """Rows of a counter table that rates over a window need.

    These are the rows of the window's days and, for the time before, of every entity the rows of its
    last time, which the index holds. The facts of earlier days are not read. Give a view such
    rows with ``Span(..., clipped=True)``.
    """
    rows = read_table(spark, root, table, from_ms, to_ms).where(in_window(F.col("fetched_at"), None, to_ms))
    if from_ms is None:
        return rows
    try:
        kept = _stored(spark, f"{root}/_last/{table}", table)
    except AnalysisException:
        return rows
    before = newest(kept.where(F.col("day") < F.to_date(F.timestamp_millis(F.lit(from_ms)))))
    return rows.unionByName(last_rows(before, ENTITIES[table]).select(rows.columns))


def compact(spark: SparkSession, root: str, table: str, day: str) -> None:
    """Rewrite one day to one version per id; readers see the same rows throughout.

    To be run while nobody writes that day.
    """
    old = versions(spark, root, table).where(F.col("day") == F.lit(day).cast("date"))
    written = [r.writer for r in old.select("writer").distinct().collect()]
    kept = newest(old).withColumn("batch", F.lit(0).cast("bigint")).withColumn("moved", F.lit(False))
    kept = kept.withColumn("writer", F.lit(f"compact-{new_writer()}"))
    _place(kept, f"{root}/{table}")
    if table in ENTITIES:
        own = _stored(spark, f"{root}/{table}", table).where(F.col("day") == F.lit(day).cast("date"))
        own = own.where(~F.col("writer").isin(written))
        _place(last_rows(own, [*ENTITIES[table], "day"]), f"{root}/_last/{table}")
        for writer in written:
            remove(spark, f"{root}/_last/{table}/day={day}/writer={writer}")
    for writer in written:
        remove(spark, f"{root}/{table}/day={day}/writer={writer}")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the lake, wherever it is stored."""
    Folder(spark, folder).remove()


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Store one micro-batch of a stream's own state; a repeated batch replaces its own output."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of all stored batches (those before ``before``), with their batch number."""
    try:
        stored = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    except AnalysisException:
        stored = spark.createDataFrame([], f"{schema}, batch bigint")
    return stored if before is None else stored.where(F.col("batch") < before)
