"""Registered queries against their SQL, and the pipeline against a plain version of its stages."""

import os

import public_tokenizers as P
import pytest

import corpus_pipeline
from checks.compare import compare, duck
from meshlens.llm import bpe, queries
from meshlens.llm.common import words
from tests.llm import test_decontam, test_jaccard

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not there")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert compare(spark, duck(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name])[0]


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def tables(tmp_path, spark):
    docs = [(i, t, "en" if t and "w" in t else None, "s", len(t or "")) for i, t in test_jaccard.corpus(5, 60)]
    items, _ = test_decontam.cases()
    docs += [(3000, "12 !!", "en", "s", 5), (3001, "call +1 (017) 555-7713 w1 now", "en", "s", 29)]
    leak = "zeta eta theta iota kappa lamda mu nu xi omicron pi rho"
    docs += [(3002, f"{leak} w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15", "en", "s", 1), (3003, leak, "en", "s", 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, leak.upper()), (2, None), (3, "unseen item of words")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


def test_pipeline_equals_plain_version(spark, tmp_path):
    docs = tables(tmp_path, spark)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    with_letters = [(i, t) for i, t, *_ in docs if t and any(c.isalpha() for c in t)]
    kept = {i for i, _, top in test_jaccard.brute(with_letters) if i == top}
    assert set(got) == kept - {3003}
    text = dict(with_letters)
    enc = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for i, r in got.items():
        decoded = enc.decode_bytes([int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]).decode()
        assert r.n_tokens * 4 == len(r.ids)
        if i == 3001:
            assert "555-7713" not in decoded and decoded.startswith("call +1 (")
        elif i == 3002:
            assert words(decoded) == [b"w%d" % k for k in range(1, 16)]
        else:
            assert decoded == text[i] and r.n_chars == len(decoded)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "'x' AS score", "1 AS n_words").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        assert name == "tokens" or out.columns == docs.columns


def chained(plan):
    """Python nodes of a plan whose input, up to the next exchange, has another one: each task holds a worker for each."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return chained(plan.initialPlan())
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    count = sum(map(chained, below))
    if plan.nodeName().endswith("InArrow"):
        while below:
            node = below.pop()
            if node.nodeName().endswith("InArrow"):
                return count + 1
            if "Exchange" not in node.nodeName():
                below += [node.children().apply(i) for i in range(node.children().size())]
    return count


def test_stages_hold_one_worker_a_task(spark, tmp_path):
    tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("decontamination", "tokens"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        assert chained(out._jdf.queryExecution().executedPlan()) == 0, name
