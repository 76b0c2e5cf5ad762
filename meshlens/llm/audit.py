"""Filter interaction audit: what each filter removes, in every order of the filters.

Method: every filter writes one table of the ids that fail it. Left-semi and left-anti joins with
these tables divide the documents, filter by filter, into those that fail it and those that don't;
after the last filter a document lies in the cell of the filters it fails. The same joins between
the cells and each prefix of an order then give the prefix's survivors, removals, redundancies and
label losses.

Plan. Texts are read once, for the verdicts that need one text alone and for a digest. From there on
only ids travel: each id table meets the documents once, so the work is linear in documents and
filters, not in orders; cells are counted per part in the tasks before they are shuffled. Ids are
numbers of rows, given when the verdicts are stored, so no id is hot; frequent texts and
frequent (or NULL) document ids are dealt over all tasks.

Cases. NULL text counts as an empty one, NULL source as an empty one. Rows that share a document id
are documents of their own, with the labels of that id; a label row with other values for an id
adds its label. A NULL document id has no labels and is neither smaller nor greater than another.
No documents give no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import hottest, join_spread, let, stored

BLANK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def few_words(text: Column) -> Column:
    """Under 50 words."""
    return F.size(words_of(text)) < 50


def few_distinct_words(text: Column) -> Column:
    """Less than 65% of the words are different ones."""
    return let(words_of(text), lambda w: F.size(F.array_distinct(w)) * 100 < F.size(w) * 65)


def many_capitals(text: Column) -> Column:
    """More than 5% of the characters are A-Z."""
    return F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 5


def code_signs(text: Column) -> Column:
    """Holds one of # $ % & * |."""
    return text.rlike(r"[#$%&*|]")


#: Name of the filter that a document fails if a smaller id has the same text.
REPEATED = "E"
#: Filters that look at one text alone.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": few_words,
    "B": few_distinct_words,
    "C": many_capitals,
    "D": code_signs,
}
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failing_ids(verdicts: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """One stored table of failing ids a filter."""
    tables = {f: stored(verdicts.where(F.col(f"fails_{f}")).select("row"), f"fails-{f}") for f in names}
    groups = verdicts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1"), "repeated-texts")
    found = join_spread(
        verdicts.select("row", "doc_id", "digest"), groups.drop("n"), ["digest"], hottest(groups, ["digest"])
    )
    tables[REPEATED] = stored(found.where("doc_id > first_id").select("row"), f"fails-{REPEATED}")
    return tables


def labelled(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """``(row, part, good, toxic)`` of every document."""
    known = (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    )
    docs = verdicts.select("row", "doc_id", "part")
    hot = hottest(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NOT NULL AND n > 1"), ["doc_id"])
    return join_spread(docs, known, ["doc_id"], hot, "left").select(
        "row", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )


def cells(docs: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """Documents per part, labels and cell (the names of the filters they fail, joined)."""
    divided = stored(docs.withColumn("cell", F.lit("")), "documents")
    for name, ids in sorted(fails.items()):
        failing = divided.join(ids, "row", "left_semi").withColumn("cell", F.concat("cell", F.lit(name)))
        passing = divided.join(ids, "row", "left_anti")
        divided = stored(failing.unionByName(passing), f"divided-{name}")
    return divided.groupBy("part", "good", "toxic", "cell").agg(F.count("*").alias("n"))


def prefixes(names: list[str]) -> list[tuple[str, int, str, str]]:
    """``(order, step, filter, filters before it)`` of every order."""
    return [
        ("".join(order), k + 1, order[k], "".join(sorted(order[:k])))
        for order in permutations(sorted(names))
        for k in range(len(order))
    ]


def interactions(counted: DataFrame, names: list[str]) -> DataFrame:
    """Measures per part, filter and set of filters before it, zeros included."""
    steps = sorted({(f, before) for _, _, f, before in prefixes(names)})
    # Which cells fail a filter, fail another one too, and are gone when the filters of a prefix have run.
    cell = counted.select("cell").distinct()
    fails = cell.select("cell", F.explode(F.split("cell", "")).alias("filter")).where("filter != ''")
    others = fails.join(fails.withColumnRenamed("filter", "other"), "cell").where("other != filter")
    others = others.select("cell", "filter").distinct()
    earlier = [(before, f) for before in sorted({b for _, b in steps}) for f in before]
    before = counted.sparkSession.createDataFrame(earlier, "before string, filter string")
    gone = before.join(fails, "filter").select("before", "cell").distinct()

    # Every cell takes every step of the orders, a fixed number of rows each.
    step = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(b).alias("before")) for f, b in steps)))
    at = counted.withColumn("_step", step).select("part", "good", "toxic", "cell", "n", "_step.*")
    by_filter, by_prefix = ["filter", "cell"], ["before", "cell"]
    failing = at.join(fails, by_filter, "left_semi")
    survivors = at.join(gone, by_prefix, "left_anti")
    n = F.col("n")
    good, toxic = F.when(F.col("good"), n).otherwise(0), F.when(F.col("toxic"), n).otherwise(0)

    def measures(rows: DataFrame, **known: Column) -> DataFrame:
        return rows.select(
            "part", "filter", "before", *(known.get(m, F.lit(0)).cast("long").alias(m) for m in MEASURES)
        )

    whole = (
        measures(at)
        .unionByName(measures(survivors.join(fails, by_filter, "left_anti"), kept=n))
        .unionByName(
            measures(survivors.join(fails, by_filter, "left_semi"), removed=n, good_lost=good, toxic_lost=toxic)
        )
        .unionByName(measures(failing.join(gone, by_prefix, "left_semi"), redundant=n))
        .unionByName(measures(failing.join(others, by_filter, "left_anti"), unique_fails=n))
    )
    return whole.groupBy("part", "filter", "before").agg(*(F.sum(m).alias(m) for m in MEASURES))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per part (source), order of the filters and step.

    ``filters`` maps a letter to a test of the text that is true for failing documents; the filter
    ``REPEATED`` is always there, behind them. With n filters there are n! orders, so keep them few.
    """
    filters = FILTERS if filters is None else filters
    text = F.col("text")
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    verdicts = whole.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        *(test(text).alias(f"fails_{f}") for f, test in filters.items()),
    )
    verdicts = stored(verdicts, "verdicts")
    names = [*filters, REPEATED]
    fails = failing_ids(verdicts, list(filters))
    counted = stored(cells(labelled(verdicts, labels), fails), "cells")
    measured = interactions(counted, names)
    steps = docs.sparkSession.createDataFrame(prefixes(names), "filter_order string, step int, filter string, before string")
    rows = measured.join(F.broadcast(steps), ["filter", "before"])
    shares = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "filter"]).select("part", "filter_order", "step", *MEASURES, "shapley")
