"""Toxicity scores that do not lean on the groups a text mentions.

A logistic regression on the distinct words of a text and on how these words begin. For every learned text that names a group,
a counterfactual text names another group of the same kind in its place; the squared difference of
the two scores is part of the loss, so a mention as such does not raise a score. FTRL with an L1
penalty keeps few words. Weights are fitted on a bounded sample, in shards whose weights are
averaged; the share of toxic rows comes from all learned labels.

A NULL text counts as the empty text, whose score is that of the bias. A NULL label is not learned
from; a document with several labels counts as toxic if one is. Without both kinds of labels every
score is the share of toxic rows. Rows are neither dropped nor merged.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlens.llm.common import add_columns, words
from meshlens.llm.ftrl import Ftrl

BITS = 18
#: Labelled texts of each class that the weights are fitted on.
SAMPLE = 4_000
#: Texts of one shard; shards are fitted side by side.
SHARD = 2_000
EPOCHS = 8
#: Lengths in bytes of the beginnings of words that count.
BEGINNINGS = range(4, 10)
#: Words whose features a scoring task keeps.
CACHE = 200_000
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
#: Words that name groups of people, by kind.
IDENTITIES = [
    "women men girls boys females males",
    "woman man girl boy female male",
    "muslims christians jews hindus buddhists atheists catholics",
    "muslim christian jewish hindu buddhist atheist catholic",
    "black white asian latino african european arab indian",
    "gay straight lesbian bisexual heterosexual homosexual transgender queer",
    "immigrants refugees foreigners natives migrants citizens",
    "blind deaf disabled autistic elderly young",
    "frauen männer mädchen jungen",
    "muslime christen juden hindus",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs hindous",
    "mujeres hombres chicas chicos",
    "musulmanes cristianos judíos hindúes",
]


def swaps() -> dict[bytes, list[bytes]]:
    """Of every identity word, the other words of its kind."""
    out: dict[bytes, list[bytes]] = {}
    for kind in IDENTITIES:
        own = [w.encode() for w in kind.split()]
        for w in own:
            out.setdefault(w, [x for x in own if x != w])
    return out


def feature(word: bytes) -> int:
    return zlib.crc32(word) & ((1 << BITS) - 1)


def features(word: bytes) -> list[int]:
    """Of a word: itself, and its first ``BEGINNINGS`` bytes where it is longer."""
    return [feature(word), *(feature(word[:k] + b"*") for k in BEGINNINGS if len(word) > k)]


def all_features(own: set[bytes]) -> set[int]:
    return {f for w in own for f in features(w)}


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    _known: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        weights, known = self.weights, self._known
        found: set[int] = set()
        for w in set(words(text)):
            own = known.get(w)
            if own is None:
                if len(known) >= CACHE:
                    known.clear()
                own = known[w] = tuple(f for f in features(w) if f in weights)
            found.update(own)
        s = self.bias + math.fsum(weights[f] for f in found)
        return 1 / (1 + math.exp(-s)) if s > -700 else 0.0


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
    alpha: float = 1.0,
    l1: float = 5.0,
    l2: float = 0.1,
    fairness: float = 1.0,
) -> Model:
    """Learn from all rows of ``labels``, ids and classes, and the texts of a sample of them."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(count.values())
    share = (count.get(1, 0) + 0.5) / (total + 1)
    prior = math.log(share / (1 - share))
    if not count.get(0) or not count.get(1):
        return Model(prior)
    order = F.xxhash64("id", F.lit(1))
    picked = [known.where(F.col("y") == y).orderBy(order, "id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * sample ids
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(chosen, "id")
    shards = max(1, round(sum(min(count[y], sample) for y in (0, 1)) / SHARD))
    fitted = (
        rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(lambda t: _fit(t, alpha, l1, l2, fairness), "at int, weight double")
        .groupBy("at")
        .agg(F.sum("weight").alias("weight"))
    )
    weights = {r["at"]: r.weight / shards for r in fitted.collect()}
    held = min(count[1], sample) / (min(count[1], sample) + min(count[0], sample))
    bias = weights.pop(1 << BITS, 0.0) + prior - math.log(held / (1 - held))
    return Model(bias, weights)


def _fit(rows: pa.Table, alpha: float, l1: float, l2: float, fairness: float) -> pa.Table:
    groups = swaps()
    order = np.random.default_rng(11)
    examples = []
    triples = zip(*(rows.column(c).to_pylist() for c in ("id", "text", "y")), strict=True)
    for _, value, y in sorted(triples, key=lambda r: (r[0], r[1] or "", r[2])):
        own = set(words(value))
        named = [w for w in own if w in groups]
        other = (own - set(named)) | {groups[w][order.integers(len(groups[w]))] for w in sorted(named)}
        here, there = all_features(own), all_features(other)
        at = np.array([*sorted(here), 1 << BITS])
        examples.append((at, y, np.array(sorted(here - there), dtype=np.int64), np.array(sorted(there - here), dtype=np.int64)))
    leader = Ftrl((1 << BITS) + 1, 1, alpha, 1.0, l1, l2)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            at, y, gone, come = examples[i]
            w = leader.weights(at)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum())))))
            leader.update(at, w, np.full_like(w, p - y))
            if len(gone) or len(come):
                a, b = leader.weights(gone), leader.weights(come)
                change = 2 * fairness * (a.sum() - b.sum())
                leader.update(gone, a, np.full_like(a, change))
                leader.update(come, b, np.full_like(b, -change))
    w = leader.weights()[:, 0]
    at = np.union1d(w.nonzero()[0], [1 << BITS])
    return pa.table({"at": pa.array(at, pa.int32()), "weight": pa.array(w[at], pa.float64())})


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted``, 1 from a score of 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS weights

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        got = [sent.value.score(t) for t in batch.column(text).to_pylist()]
        return [pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())]

    return add_columns(docs, FIELDS, run, keep)
