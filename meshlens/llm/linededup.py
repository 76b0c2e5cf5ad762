"""Line dedup: lines found in several documents stay in the first one only.

Method: every text is cut at line feeds and exploded to one row a line; a line's key (white space
stripped at both ends, A-Z lowered) is hashed to 128 bits; documents are counted per hash; lines of
a hash that is in enough documents are dropped, but for those in the smallest document id that
holds it; the lines left are put together again by position.

Plan. Lines travel as hashes only, once to be counted (distinct documents per hash, combined in
the tasks first) and once to meet the counts. The ``HOT`` most frequent lines are dealt over all
tasks for that. Texts are shuffled once, by a digest of document id and text, to meet the positions
to drop; equal rows collapse to one with a number of copies before, so that a row repeated very
often is no hot key.

Cases. NULL text counts as an empty one, which is one empty line. A document is its id: rows that
share an id count as one document, each row is still returned on its own. NULL ids together are
one document that comes after all others. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import hottest, join_spread, let, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
#: Shorter keys (in code points) are never dropped.
LEAST_CHARS = 10
#: Documents that must hold a line before it is dropped.
LEAST_DOCS = 2


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lowered; other letters keep their case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def keyed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """``(_r1, _r2, _id, _pos, _h1, _h2)`` of every line that is long enough."""
    lines = docs.select("_r1", "_r2", "_id", F.posexplode(lines_of(F.col("_text"))).alias("_pos", "_line"))
    keys = lines.select("_r1", "_r2", "_id", "_pos", line_key(F.col("_line")).alias("_key"))
    long_enough = keys.where(F.length("_key") >= least_chars)
    return long_enough.select(
        "_r1", "_r2", "_id", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")
    )


def shared_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """``(_h1, _h2, _first, n)``: hashes in enough documents, the id that keeps the line, its lines."""
    per_doc = lines.groupBy("_h1", "_h2", "_id").agg(F.count("*").alias("n"))
    return (
        per_doc.groupBy("_h1", "_h2")
        .agg(F.count("*").alias("_docs"), F.min("_id").alias("_first"), F.sum("n").alias("n"))
        .where(F.col("_docs") >= least_docs)
        .select("_h1", "_h2", "_first", "n")
    )


def dedupe_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """Per row of ``docs``: ``(<doc_id>, <text> without its dropped lines, n_lines, n_dropped)``."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select(
        F.xxhash64("_id", "_text").alias("_r1"), F.xxhash64(F.lit(1), "_id", "_text").alias("_r2"), "_id", "_text"
    )
    lines = keyed_lines(rows, least_chars)
    shared = stored(shared_lines(lines, least_docs), "shared-lines")
    found = join_spread(lines, shared.drop("n"), ["_h1", "_h2"], hottest(shared, ["_h1", "_h2"]))
    dropped = (
        found.where(~F.col("_id").eqNullSafe(F.col("_first")))
        .groupBy("_r1", "_r2")
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    once = rows.groupBy("_r1", "_r2").agg(
        F.first("_id").alias("_id"), F.first("_text").alias("_text"), F.count("*").alias("_copies")
    )
    gone = F.coalesce("_gone", F.array().cast("array<int>"))

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    joined = once.join(dropped, ["_r1", "_r2"], "left").select(
        F.col("_id").alias(doc_id),
        let(lines_of(F.col("_text")), kept).alias(text),
        F.size(lines_of(F.col("_text"))).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        "_copies",
    )
    copies = F.sequence(F.lit(1).cast("long"), F.col("_copies"))
    return joined.withColumn("_copies", F.explode(copies)).drop("_copies")
