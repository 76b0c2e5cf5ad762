"""Byte-level BPE encoding and decoding over overlapping chunks.

A text longer than one chunk is cut into chunks that overlap. Chunks are rows of their own, so one
very long text is pre-tokenised by many tasks. A chunk starts at an arbitrary place, and its first
pre-tokens may be wrong; as the pattern looks at nothing before a match, the pre-tokens agree with
those of the whole text from the first boundary that the chunk shares with its predecessor in
their overlap. There the text is cut. Where a run without any boundary fills an overlap, the two
chunks stay in one piece. The pieces are then encoded in parallel and joined.

Ids leave as little-endian unsigned 32-bit integers in one binary value. NULL counts as the empty
text; both give an empty value. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlens.llm.common import add_columns

CHUNK = 32_768
OVERLAP = 1_024
#: A boundary so near a chunk's end may still depend on what follows.
MARGIN = 16
_KEY = "__bpe_digest"


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """The encoder of a rank file, made once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids_of(text: str, path: str, pattern: str) -> bytes:
    return np.array(encoder(path, pattern).encode_ordinary(text), dtype="<u4").tobytes()


def bytes_of(ids: list[bytes | None], path: str, pattern: str) -> list[bytes]:
    enc = encoder(path, pattern)
    return [enc.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in ids]


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of pre-tokens (not the first) that follow no white space."""
    import regex

    starts = (m.start() for m in regex.finditer(pattern, text))
    return [b for b in starts if b and not text[b - 1].isspace()]


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    keep: list[str] | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    decoded: str | None = None,
) -> DataFrame:
    """Add ``ids``: the token ids of ``text``. ``keep``: input columns to keep (default: all).

    An existing column named ``ids`` is replaced. Repeated rows give repeated rows. ``decoded`` names a
    column for what the ids decode to, as ``decode`` adds it, but in the same Python worker as the ids.
    """
    long = F.coalesce(F.length(text), F.lit(0)) > chunk + overlap
    made = [ids, *([decoded] if decoded else [])]
    kept = [c for c in df.columns if c not in made and (keep is None or c in keep)]

    def whole(batch: pa.RecordBatch) -> list[pa.Array]:
        got = [ids_of(t or "", path, pattern) for t in batch.column(text).to_pylist()]
        columns = [got, bytes_of(got, path, pattern)] if decoded else [got]
        return [pa.array(c, pa.binary()) for c in columns]

    short = add_columns(df.where(~long), [T.StructField(c, T.BinaryType()) for c in made], whole, kept)
    digest = F.sha2(F.col(text).cast("binary"), 256).alias(_KEY)
    texts = df.where(long).select(digest, F.col(text).alias("text")).dropDuplicates([_KEY])
    joined = _encode_long(texts, path, pattern, chunk, overlap)
    rows = df.where(long).select(digest, *kept).join(joined, _KEY)
    rows = rows.select(*kept, F.col("__bpe_ids").alias(ids))
    return short.unionByName(decode(rows, path, pattern, ids, decoded) if decoded else rows)


def _encode_long(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Ids of distinct long texts, one row per digest."""
    piece = T.StructType(
        [T.StructField(_KEY, T.StringType()), T.StructField("at", T.LongType()), T.StructField("piece", T.StringType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = range(0, max(1, len(t) - overlap), chunk)
                yield _batch([(key, s, t[s : s + chunk + overlap]) for s in starts], piece)

    ends = T.StructType(
        [
            T.StructField(_KEY, T.StringType()),
            T.StructField("at", T.LongType()),
            T.StructField("head", T.ArrayType(T.LongType())),
            T.StructField("tail", T.ArrayType(T.LongType())),
        ]
    )

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = boundaries(t, pattern)
                head = [s + b for b in found if b < overlap] if s else []
                tail = [s + b for b in found if chunk < b < len(t) - MARGIN]
                rows.append((key, s, head, tail))
            yield _batch(rows, ends)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = [0, *cuts, len(t)]
                yield _batch([(key, a, t[a:b]) for a, b in zip(at, at[1:], strict=False)], piece)

    chunks = texts.mapInArrow(cut, piece).repartition(_KEY, "at")
    found = chunks.mapInArrow(edges, ends).groupBy(_KEY)
    sides = found.agg(F.array_sort(F.collect_list(F.struct("at", "head", "tail"))).alias("sides"))
    pieces = (
        texts.join(sides, _KEY)
        .select(_KEY, "text", _cuts(F.col("sides")).alias("cuts"))
        .mapInArrow(split, piece)
        .repartition(_KEY, "at")
    )
    coded = add_columns(
        pieces,
        [T.StructField("coded", T.BinaryType())],
        lambda b: [pa.array([ids_of(t, path, pattern) for t in b.column("piece").to_pylist()], pa.binary())],
        [_KEY, "at"],
    )
    parts = F.array_sort(F.collect_list(F.struct("at", F.hex("coded").alias("hex"))))
    return coded.groupBy(_KEY).agg(
        F.unhex(F.array_join(F.transform(parts, lambda p: p["hex"]), "")).alias("__bpe_ids")
    )


def _cuts(sides: Column) -> Column:
    """First boundary that each chunk shares with the next one; none where they share none."""
    pairs = F.arrays_zip(
        F.slice(sides, F.lit(1), F.size(sides) - 1).alias("a"),
        F.slice(sides, F.lit(2), F.greatest(F.size(sides) - 1, F.lit(0))).alias("b"),
    )
    shared = F.transform(pairs, lambda p: F.array_min(F.array_intersect(p["a"]["tail"], p["b"]["head"])))
    return F.filter(shared, lambda x: x.isNotNull())


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    arrays = [pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def decode(
    df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None
) -> DataFrame:
    """Add ``decoded``: the raw bytes of ``ids`` concatenated. NULL gives an empty value."""

    def whole(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(bytes_of(batch.column(ids).to_pylist(), path, pattern), pa.binary())]

    return add_columns(df, [T.StructField(decoded, T.BinaryType())], whole, keep)
