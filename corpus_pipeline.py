"""From raw documents to token ids: language, copies, benchmark leaks, private data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.llm import bpe, decontam, jaccard, langid, pii
from meshlens.llm.common import send_package, stored
from meshlens.llm.queries import KEY, table, vocabulary

#: Documents in no language with at least this calibrated probability go.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language. Those without letters, or in no learned language, go.

    Learns from the documents that name their language; if none does, all with letters stay.
    """
    send_package(spark)
    model = langid.train(docs.select("text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model, lang="__lang", score="__score")
    return found.where(F.col("__score") >= LEAST_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest id."""
    send_package(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that mostly consist of them go."""
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by consistent surrogates."""
    return pii.pseudonymise(docs, KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    send_package(spark)
    path, pattern = vocabulary()
    kept = ["doc_id", "lang", "source", "n_chars"]
    coded = bpe.encode(docs, path, pattern, keep=kept, decoded="decoded")
    decoded = F.sha2("decoded", 256).alias("decoded_sha256")
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", "lang", "source", "n_chars", n_tokens, "ids", decoded)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("tokens", tokens),
]
#: No SQL expresses the first stage (a fitted model); tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
