"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of 1 to 3 letters (anything else counts as one space), weighted by
TF-IDF. Document frequencies cover every row that may be learned from. The weights are fitted by
FTRL with elastic-net penalties on a bounded sample, in shards whose weights are averaged; part of
the sample is kept apart to fit the temperature of the scores.

A text that is NULL or has no letters is ``und`` with score 0. Rows with a NULL language are not
learned from. Without any row to learn from, every text is ``und``. Rows are neither dropped nor
merged; columns named like the results are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlens.llm.common import add_columns, parts
from meshlens.llm.ftrl import Ftrl, softmax

BITS = 15
#: Texts of each language that the weights and the temperature are fitted on.
SAMPLE = 2_000
#: Texts of one shard; shards are fitted side by side.
SHARD = 2_000
EPOCHS = 3
UNKNOWN = "und"
#: Code points counted at a time.
PART = 1 << 18


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Of every code point: itself if a letter, else a space."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs; none if it has no letters."""
    counts = np.zeros(1 << BITS, dtype=np.int64)
    any_letter = False
    lowered = (text or "").lower()
    before = np.zeros(0, dtype=np.uint32)
    for start in range(0, len(lowered), PART):
        data = lowered[start : start + PART].encode("utf-32-le", "surrogatepass")
        c = np.concatenate((before, letters()[np.frombuffer(data, dtype=np.uint32)]))
        c = c[(c != 32) | np.concatenate(([True], c[:-1] != 32))]
        any_letter |= bool((c != 32).any())
        old = len(before)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + one[2:]
        for h in (one[old:], two[max(0, old - 1) :], three[max(0, old - 2) :]):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
        before = c[-2:]
    at = counts.nonzero()[0] if any_letter else np.zeros(0, dtype=np.int64)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        at, counts = grams(text)
        if not len(at) or not self.languages:
            return None
        x = weighted(at, counts, self.idf)
        return x @ self.weights[at] + self.bias


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt((x * x).sum())


def train(
    rows: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    alpha: float = 0.5,
    l1: float = 0.02,
    l2: float = 0.5,
) -> Model:
    """Learn from all ``rows`` that have a language: frequencies from all, weights from a sample."""
    known = rows.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    key = F.xxhash64("text", F.lit(1)).alias("key")
    keyed = known.groupBy("lang", key).agg(F.count("*").alias("n"))  # copies collapse before the shuffle
    sizes = keyed.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    count, distinct = {r.lang: r.n for r in sizes}, {r.lang: r.texts for r in sizes}
    languages = sorted(count)
    if not languages:
        return Model([], np.ones(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0))
    total = sum(count.values())
    idf = np.full(1 << BITS, np.log(1 + total))
    for r in _frequencies(known).collect():  # one row a feature at most
        idf[r.at] = np.log((1 + total) / (1 + r.n)) + 1

    chosen = sampled(known, distinct, sample).withColumn("fold", F.pmod(F.xxhash64("text", F.lit(2)), F.lit(5)))
    shards = max(1, round(sum(min(n, sample) for n in distinct.values()) / SHARD))
    context = rows.sparkSession.sparkContext
    sent = context.broadcast((languages, idf))
    chosen = chosen.withColumn("shard", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(shards))).persist()
    fitted = (
        chosen.where("fold > 0")
        .groupBy("shard")
        .applyInArrow(
            lambda t: _fit(t, sent.value, alpha, l1, l2),
            "at int, weights array<double>",
        )
        .groupBy("at")
        .agg(F.array(*[F.sum(F.col("weights")[k]) for k in range(len(languages))]).alias("w"), F.count("*").alias("n"))
    )
    weights = np.zeros(((1 << BITS) + 1, len(languages)))
    for r in fitted.collect():
        weights[r["at"]] = np.array(r.w) / shards
    model = Model(languages, idf, weights[:-1], weights[-1])
    model.temperature = _temperature(chosen.where("fold = 0"), model)
    chosen.unpersist()
    return model


def sampled(known: DataFrame, distinct: dict[str, int], sample: int) -> DataFrame:
    """``text, lang``: of each language the ``sample`` different texts of the least hashes, once each.

    ``distinct`` holds the number of different texts of every language.
    """

    def up_to(bound: dict[str, int]) -> DataFrame:
        limits = F.create_map(*[F.lit(x) for item in bound.items() for x in item])
        return known.withColumn("key", F.xxhash64("text", F.lit(1))).where(F.col("key") <= F.element_at(limits, F.col("lang")))

    # somewhat more than are wanted, so that few are put in order
    share = {k: min(1.0, (1.5 * sample + 100) / n) for k, n in distinct.items()}
    near = up_to({k: min(int(x * 2**64) - 2**63, 2**63 - 1) for k, x in share.items()}).select("lang", "key").distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy("key"))
    least = near.withColumn("rank", rank).where(F.col("rank") <= sample).groupBy("lang").agg(F.max("key").alias("key"))
    bound = {r.lang: r.key for r in least.collect()}
    return up_to(bound).groupBy("key", "lang").agg(F.first("text").alias("text")).select("text", "lang")


def _frequencies(known: DataFrame) -> DataFrame:
    """In how many texts each feature occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BITS, dtype=np.int64)
        for batch in parts(batches):
            for t in batch.column(0).to_pylist():
                n[grams(t)[0]] += 1
        at = n.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["at", "n"])

    return known.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))


def _fit(rows: pa.Table, learned: tuple[list[str], np.ndarray], alpha: float, l1: float, l2: float) -> pa.Table:
    languages, idf = learned
    pairs = sorted(zip(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), strict=True), key=lambda p: (p[0] or "", p[1]))
    found = [(grams(t), languages.index(k)) for t, k in pairs]
    examples = [(at, weighted(at, n, idf), k) for (at, n), k in found if len(at)]
    leader = Ftrl((1 << BITS) + 1, len(languages), alpha, 1.0, l1, l2)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            at, x, k = examples[i]
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = leader.weights(at)
            p = softmax(x @ w)
            p[k] -= 1
            leader.update(at, w, np.outer(x, p))
    w = leader.weights()
    at = np.abs(w).sum(axis=1).nonzero()[0]
    return pa.table({"at": pa.array(at, pa.int32()), "weights": pa.array(w[at].tolist(), pa.list_(pa.float64()))})


def _temperature(kept: DataFrame, model: Model) -> float:
    """The temperature under which the texts kept apart are likeliest."""
    steps = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    sent = kept.sparkSession.sparkContext.broadcast(model)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(steps))
        for batch in batches:
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                logits = sent.value.logits(t)
                if logits is not None:
                    p = softmax(logits[None, :] / steps[:, None])
                    total -= np.log(p[:, sent.value.languages.index(k)] + 1e-12)
        columns = [pa.array(range(len(steps)), pa.int32()), pa.array(total, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["step", "loss"])

    loss = kept.select("text", "lang").mapInArrow(losses, "step int, loss double").groupBy("step").agg(F.sum("loss").alias("loss"))
    sums = {r.step: r.loss for r in loss.collect()}
    return float(steps[min(sums, key=lambda k: (sums[k], k))]) if any(sums.values()) else 1.0


def predict(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    keep: list[str] | None = None,
    lang: str = "lang_pred",
    score: str = "score",
) -> DataFrame:
    """Add the predicted language and its calibrated probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        names, scores = [], []
        for t in batch.column(text).to_pylist():
            logits = sent.value.logits(t)
            p = softmax(logits / sent.value.temperature) if logits is not None else None
            names.append(UNKNOWN if p is None else sent.value.languages[int(p.argmax())])
            scores.append(0.0 if p is None else min(1.0, float(p.max())))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    fields = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return add_columns(docs, fields, run, keep)
