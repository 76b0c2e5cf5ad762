"""Substring dedup by hashes of lines, of the sentences in them and of parts of long sentences.

A text is cut into lines, and a line after each sentence of at least ``LEAST_WORDS`` words; shorter
sentences belong to the unit that follows. What is still long is cut where the content says so: after
the words whose hash, with the two words before, is the least of all within ``REACH`` words on both
sides, if the nearest other cut is further away than that. Where a unit ends depends on the words
around alone, so the units inside a passage are the same wherever it stands, but for those at its
ends: of a passage that begins and ends inside sentences about a unit is left at both.

In scripts without spaces two characters count as a word, and a full stop needs no space behind it.
Units are normalised (lower case, runs of white space as one space) and hashed; a unit of fewer words
than ``LEAST_WORDS`` (and fewer than ``LEAST_CHARS`` characters) is left alone.

Of equal units, wherever they are, the one that stands earliest is kept, by document id and place;
the others are removed. Offsets are code points of the original text.

NULL and empty texts have no units. Rows of equal id count as one document: a unit in several of
them counts once, and all of them keep it. Rows without an id rank after all others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlens.llm.common import add_columns, parts, stored

LEAST_WORDS = 6
LEAST_CHARS = 60
#: Words around a cut by content that hold no other cut: units have LEAST_WORDS at least.
REACH = LEAST_WORDS - 1
_END = re.compile(r"[.!?…。！？]+(?:(?=\s)|(?<=[。！？]))\s*|\n")
#: Characters of scripts without spaces: Thai to Burmese, Khmer, kana and Han.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_IS_DENSE = re.compile(f"[{_DENSE}]")
_SPACED = re.compile(r"\S+")
_WORD = re.compile(f"[{_DENSE}]|[^\\s{_DENSE}]+")
#: The rank of rows without an id.
_LAST = (1 << 63) - 1


def _halves(part: str, dense: bool) -> int:
    """Size in half words."""
    if not dense:
        return 2 * len(part.split())
    return sum(1 if _IS_DENSE.match(w) else 2 for w in _WORD.findall(part))


def _cuts(text: str, pieces: list[tuple[int, int]], dense: bool) -> list[int]:
    """The places inside ``pieces`` where the content says to cut."""
    words = [[*(_WORD if dense else _SPACED).finditer(text, a, b)] for a, b in pieces]
    found = [m for piece in words for m in piece]
    hashes = np.array([zlib.crc32(m[0].lower().encode("utf-8", "surrogatepass")) for m in found], np.uint64)
    halves = np.array([1 if _IS_DENSE.match(m[0]) else 2 for m in found]) if dense else np.full(len(found), 2)
    sizes = np.array([len(piece) for piece in words])
    own = np.repeat(np.arange(len(words)), sizes)
    behind = np.cumsum(halves)  # half words up to the end of a word
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed[1:] += hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed[2:] += hashes[:-2] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    for k in range(2):  # there the words before are another piece's
        mixed[np.minimum(first + k, last)] = np.iinfo(np.uint64).max
    room = np.minimum(behind - (behind - halves)[first][own], behind[last][own] - behind)
    cut = room > 2 * REACH
    for k in range(1, min(2 * REACH if dense else REACH, len(found) - 1) + 1):
        near = (own[k:] == own[:-k]) & (behind[k:] - behind[:-k] <= 2 * REACH)
        cut[:-k] &= ~(near & (mixed[k:] <= mixed[:-k]))
        cut[k:] &= ~(near & (mixed[:-k] <= mixed[k:]))
    return [found[i].end() for i in np.flatnonzero(cut)]


def units(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, normalised)`` of the units of a text that count."""
    text = text or ""
    dense = bool(_IS_DENSE.search(text))
    ends, long = [], []
    start = sentence = 0
    for cut in [*(m for m in _END.finditer(text)), None]:
        end = cut.end() if cut else len(text)
        line_ends = cut is None or "\n" in cut[0]
        size = _halves(text[sentence:end], dense)
        if line_ends or size >= 2 * LEAST_WORDS:
            if size > 4 * REACH or start < sentence and _halves(text[start:end], dense) > 4 * REACH:
                long.append((start, end))
            ends.append(end)
            start = end
        sentence = end
    if long:
        ends = sorted({*ends, *_cuts(text, long, dense)})
    out = []
    start = 0
    for end in ends:
        part = text[start:end]
        plain = " ".join(part.split()).lower()
        if _halves(part, dense) >= 2 * LEAST_WORDS or len(plain) >= LEAST_CHARS:
            lead = len(part) - len(part.lstrip())
            out.append((start + lead, start + len(part.rstrip()), plain))
        start = end
    return out


def _digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row for each unit of a document and each place of it: ``id, k1, k2, start, end, nth``.

    ``nth`` counts the places of a unit in its document from 0.
    """
    import xxhash

    schema = "id long, k1 long, k2 long, start long, end long, nth int"
    names = ["id", "k1", "k2", "start", "end", "nth"]
    kinds = (pa.int64(),) * 5 + (pa.int32(),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            rows = []
            for i, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                seen: dict[bytes, int] = {}
                for start, end, plain in units(t):
                    digest = xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass"))
                    nth = seen[digest] = seen.get(digest, -1) + 1
                    k1 = int.from_bytes(digest[:8], "little", signed=True)
                    k2 = int.from_bytes(digest[8:], "little", signed=True)
                    rows.append((_LAST if i is None else i, k1, k2, start, end, nth))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The places to remove: ``doc_id, start, end, kept_doc_id``, one row each.

    ``kept_doc_id`` is the document whose place of the unit is kept (NULL: it has no id).
    """
    found = stored(_digests(docs, doc_id, text), "repeats-units")
    # copies of a unit collapse before the shuffle; what stands once goes no further
    first = (
        found.groupBy("k1", "k2")
        .agg(F.min("id").alias("kept"), F.max("id").alias("last"), F.max("nth").alias("most"))
        .where("kept < last OR most > 0")
        .select("k1", "k2", "kept")
    )
    gone = found.join(first, ["k1", "k2"]).where("id != kept OR nth > 0")
    named = [F.nullif(c, F.lit(_LAST)).alias(n) for c, n in (("id", "doc_id"), ("kept", "kept_doc_id"))]
    return gone.select(named[0], "start", "end", named[1]).distinct()


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars"
) -> DataFrame:
    """Documents without their repeated places; ``removed`` holds the ranges cut out (flat).

    All other text stays, byte for byte; ``n_chars``, where there is such a column, is counted anew
    for documents that lost text. A column named ``removed`` is replaced. Rows that share an id all
    lose the ranges found for it only where their texts have those units; rows without an id stay.
    """
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    gone = repeated(docs, doc_id, text).where("doc_id IS NOT NULL")
    # a document has no more ranges than units
    by_doc = gone.groupBy(F.col("doc_id").alias("__id")).agg(spans.alias("__spans"))
    rows = docs.join(by_doc, F.col(doc_id).cast("long") == F.col("__id"), "left").drop("__id")
    fields = [T.StructField("__text", T.StringType()), T.StructField("removed", T.ArrayType(T.LongType()))]
    kept = [c for c in docs.columns if c != "removed"]

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, ranges = [], []
        for t, found in zip(batch.column(text).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
            own = {(a, b) for a, b, _ in units(t)} if found else set()
            flat = [(s["start"], s["end"]) for s in found or [] if (s["start"], s["end"]) in own]
            texts.append(without(t, flat) if flat else t)
            ranges.append([x for pair in flat for x in pair])
        return [pa.array(texts, pa.string()), pa.array(ranges, pa.list_(pa.int64()))]

    made = add_columns(rows, fields, cut)
    changed = {text: F.col("__text")}
    if n_chars in kept:
        count = F.length("__text").cast(docs.schema[n_chars].dataType)
        changed[n_chars] = F.when(F.size("removed") > 0, count).otherwise(F.col(n_chars))
    return made.select(*(changed.get(c, F.col(c)).alias(c) for c in kept), "removed")


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    out, last = [], 0
    for start, end in ranges:
        out.append(text[last:start])
        last = end
    return "".join([*out, text[last:]])
