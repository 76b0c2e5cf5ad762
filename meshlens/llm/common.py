"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII letters lowered, and every byte outside digits, letters and non-ASCII made a space.
WORD_BYTES = bytes(
    c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
#: ASCII letters lowered; white space alone divides words.
LOWER_BYTES = bytes(c | 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of a batch that are Python objects at one time.
ROWS = 256
#: Rows that Spark hands to Python at one time: texts may be long, and a batch is held on both sides.
BATCH_ROWS = 1024
#: Keys that count as frequent: a fixed number, so that a table of them may be broadcast.
HOT = 1000


def words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z, as UTF-8."""
    return raw(text).translate(WORD_BYTES).split()


def plain_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z, as UTF-8."""
    return raw(text).translate(LOWER_BYTES).split()


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the folder all executors share and read it back: cuts lineage."""
    path = f"{shared_folder(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="meshlens-llm-")


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once, as ``--py-files`` would, and bound the session's Arrow batches.

    The bound changes no result, only memory; a smaller one that the session has already stays.
    """
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(option)) <= BATCH_ROWS:
        spark.conf.set(option, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="meshlens-py-")) / "meshlens.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(str(path))
        _SENT.add(context.applicationId)
    return spark


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of ``ROWS`` rows, so that few texts are Python objects at one time."""
    try:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield batch.slice(start, ROWS)
    finally:
        give_back()


def give_back() -> None:
    """Return what a task has freed to the system: Python workers stay for the stages to come."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed batch by batch; an existing column of such a name is replaced.

    ``keep`` names the input columns the result still has (default: all).
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema if f.name not in new and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            arrays = [part.column(f.name) for f in kept] + compute(part)
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bucket(column: str, n: int) -> Column:
    """crc32 of a column's text modulo ``n``; NULL for NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def hottest(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The ``HOT`` most frequent keys; every other key has a thousandth of all rows at most."""
    return counts.orderBy(F.desc(n), *keys).limit(HOT).select(*keys)


def join_spread(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with a table of unique keys; rows of ``hot`` keys and of NULL keys are dealt over all tasks.

    ``hot`` has ``HOT`` keys at most, so that it may be broadcast, and so that their copies, one
    a task, stay few. ``many`` should come from a stored table: the salt counts rows.
    """
    salts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    unmatched = F.lit(False)
    for k in keys:
        unmatched = unmatched | F.col(k).isNull()
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    dealt = many.join(marked, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | unmatched, salt).otherwise(F.lit(0))
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = one.join(marked, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.drop("_hot").join(copied, [*keys, "_salt"], how).drop("_salt")
