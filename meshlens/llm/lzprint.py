"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each phrase is the longest known one and one more code
point). The phrases are hashed, and the ``SIZE`` smallest distinct hashes are the fingerprint, as
lowercase hexadecimal digits. Two fingerprints are as alike as the share of common hashes among the
``SIZE`` smallest of both together, an estimate of the Jaccard likeness of the phrase sets (exact
for sets that small). NULL counts as the empty text; its fingerprint is empty, like only to another
empty one. Equal texts have equal fingerprints.

``with_successor`` pairs every row with the next one in descending order of the ids, without a sort
in one task: rows are cut into ranges of ids, and the first row of a range is also sent to the range
before it. Rows with equal ids follow each other in order of their texts; NULL ids come last.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlens.llm.common import parts

SIZE = 64
#: Hexadecimal digits of one hash.
DIGITS = 12
#: Ranges of ids, whatever the number of partitions.
MOST_RANGES = 2048
#: Code points whose phrases are hashed at a time.
PART = 1 << 18
#: From a phrase of so many code points on, a text's phrases are found by halving and not grown one by one.
LONG = 64
_BASE = 0x9E3779B97F4A7C15


class Parsed(NamedTuple):
    """Ends of phrases and the begun phrase at the end of a text."""

    ends: list[int]
    node: str


def parse(text: str, known: dict[str, None], node: str, at: int) -> Parsed:
    """Go on parsing: ``known`` gets the new phrases in order, ``at`` is where ``text`` begins, ``node`` is begun."""
    size = len(known)
    phrase = node or ""
    start = at - len(phrase)
    long = len(phrase) >= LONG
    for c in "" if long else text:
        phrase += c
        if phrase not in known:
            known[phrase] = None
            long = len(phrase) >= LONG
            phrase = ""
            if long:
                break
    ends = list(itertools.accumulate(map(len, itertools.islice(known, size, None)), initial=start))[1:]
    if not long:
        return Parsed(ends, phrase)
    done = ends[-1] if ends else start
    return _parse_long(phrase + text[max(0, done - at) :], known, ends, done)


def _parse_long(text: str, known: dict[str, None], ends: list[int], at: int) -> Parsed:
    """Go on with a text that has phrases of ``LONG`` code points: as every beginning of a phrase is one, by halving."""
    start, length = 0, 1
    while start < len(text):
        low, high = 0, length  # the known beginning is at least low, and less than high
        while text[start : start + high] in known and start + high < len(text):
            low, high = high, min(2 * high, len(text) - start)
        if text[start : start + high] in known:
            return Parsed(ends, text[start:])
        while high - low > 1:
            middle = (low + high) // 2
            if text[start : start + middle] in known:
                low = middle
            else:
                high = middle
        known[text[start : start + high]] = None
        start, length = start + high, high
        ends.append(at + start)
    return Parsed(ends, "")


def _powers(base: int) -> np.ndarray:
    out = np.full(PART + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER = _powers(_BASE)
_BACK = _powers(pow(_BASE, -1, 1 << 64))


def hashes(text: str, start: int, ends: list[int]) -> np.ndarray:
    """A hash of each phrase; phrases follow each other from ``start``."""
    out = []
    at = 0
    while at < len(ends):
        stop = max(at + 1, bisect.bisect_right(ends, start + PART, at))
        bounds = np.array([start, *ends[at:stop]], dtype=np.int64) - start
        codes = np.frombuffer(text[start : ends[stop - 1]].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        power, back = _POWER, _BACK
        if len(codes) > PART:  # a single phrase
            power = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), _BASE, np.uint64)], dtype=np.uint64)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
        h = (sums[bounds[1:]] - sums[bounds[:-1]]) * back[bounds[:-1]]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        out.append(h >> np.uint64(64 - 4 * DIGITS))
        start, at = ends[stop - 1], stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def smallest(found: np.ndarray) -> np.ndarray:
    if len(found) > 2 * SIZE:  # phrases differ, so equal hashes are few
        found = np.partition(found, 2 * SIZE)[: 2 * SIZE]
    return np.unique(found)[:SIZE]


def prints(text: str, keep: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``text`` and of its first ``keep`` code points followed by ``tail``.

    The common part is parsed once; what the first text's rest adds is taken back.
    """
    known: dict[str, None] = {}
    ends, node = parse(text[:keep], known, "", 0)
    common, start = hashes(text, 0, ends), ends[-1] if ends else 0
    size = len(known)
    rest = parse(text[keep:], known, node, keep).ends
    own = smallest(np.concatenate((common, hashes(text, start, rest))))
    while len(known) > size:
        known.popitem()
    edited = text[:keep] + tail
    rest = parse(tail, known, node, keep).ends
    return own, smallest(np.concatenate((common, hashes(edited, start, rest))))


def as_text(found: np.ndarray) -> str:
    return found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the smallest of both; 1 for two empty fingerprints."""
    both = np.sort(np.concatenate((a, b)))
    if not len(both):
        return 1.0
    again = both[1:] == both[:-1]  # each print's hashes are distinct
    rank = np.arange(1, len(both)) - np.cumsum(again)  # of the different ones, from 0
    size = min(SIZE, len(both) - int(again.sum()))
    return float((again & (rank < size)).sum()) / size


def with_successor(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``id, text, range, extra`` in descending order of id within each partition's ranges.

    The rows with ``extra`` are the first ones of the next range (of the first range after the
    last), so that the row after any row of a range is in the same partition, next in order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(1, min(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    edges = rows.stat.approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    edges = sorted(set(edges), reverse=True)
    number = _range(F.col("id").cast("double"), edges, 0, len(edges))
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), len(edges) + 1).otherwise(number))
    heads = {r["range"]: r.id for r in rows.groupBy("range").agg(F.max("id").alias("id")).collect()}
    used = sorted(heads)
    if not used:
        return rows.withColumn("extra", F.lit(False))
    before = dict(zip(used, [used[-1], *used[:-1]], strict=True))
    head = F.array(*[F.lit(heads.get(k)).cast("long") for k in range(len(edges) + 2)])
    prior = F.array(*[F.lit(before.get(k)).cast("int") for k in range(len(edges) + 2)])
    first = F.col("id").eqNullSafe(F.get(head, F.col("range")))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("extra"))
    again = F.struct(F.get(prior, F.col("range")).alias("range"), F.lit(True).alias("extra"))
    sent = rows.withColumn("to", F.explode(F.when(first, F.array(own, again)).otherwise(F.array(own))))
    return (
        sent.select("id", "text", "to.range", "to.extra")
        .repartition(n, "range")
        .sortWithinPartitions("range", "extra", F.col("id").desc_nulls_last(), "text")
    )


def _range(x: Column, edges: list[float], low: int, high: int) -> Column:
    """How many of the descending ``edges`` are above ``x``, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(x < edges[middle], _range(x, edges, middle + 1, high)).otherwise(_range(x, edges, low, middle))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are.

    The edited form: the last half (rounded down) of the code points replaced by as many of the
    next document's first ones, or all. ``next_id`` is the next document's id.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
            T.StructField("next_id", T.LongType()),
        ]
    )
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the row before: its successor's text is known, its fingerprint not yet
        last = None
        for batch in parts(batches):
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number, value, where, extra = row
                if last is not None and last[2] == where:
                    if last[3]:
                        continue  # further rows of the next range
                    made = _printed(last, value)
                    if waiting:
                        done.append((*waiting[0], likeness(waiting[1], made[1]), waiting[2]))
                    waiting = (*made, number)
                    if extra:
                        done.append((*waiting[0], likeness(waiting[1], prints(value, len(value), "")[0]), number))
                        waiting = None
                last = row
            columns = list(zip(*done, strict=True)) if done else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    return with_successor(docs, doc_id, text).mapInArrow(run, schema)


def _printed(row: tuple, after: str) -> tuple[tuple, np.ndarray]:
    """The columns of a row whose next text is ``after``, but for those on the next fingerprint."""
    number, value = row[:2]
    half = len(value) // 2
    keep = len(value) - half
    own, edited = prints(value, keep, after[:half])
    columns = (number, len(value), value[:keep] + after[:half], as_text(own), as_text(edited), likeness(own, edited))
    return columns, own
