import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from meshlens.llm import bpe

PATH, PATTERN = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
SCHEMA = "doc_id long, text string, ids string, extra int"


def brute(text):
    return bpe.encoder(PATH, PATTERN).encode_ordinary(text or "")


def texts():
    rng = random.Random(4)
    alphabet = ["word", " ", "  ", "\n", "'ll", "'", "42", "é", "漢字", "🙂", "!?", "\t\t", "\x1c", " a", "x" * 70, " " * 40]
    mixed = ["".join(rng.choices(alphabet, k=rng.randint(0, 200))) for _ in range(40)]
    return [*mixed, None, "", "a", "ab" * 400, " " * 500, "\n" * 300 + "b", "word " * 300, "日" * 400, mixed[0], "don't " * 90]


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (40, 8), (300, 64), (bpe.CHUNK, bpe.OVERLAP)])
def test_encode_equals_library_and_round_trips(spark, chunk, overlap):
    rows = [(i, t, "old", i) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    coded = bpe.encode(df, PATH, PATTERN, chunk=chunk, overlap=overlap)
    assert coded.columns == ["doc_id", "text", "extra", "ids"]
    got = bpe.decode(coded, PATH, PATTERN).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == brute(r.text), repr(r.text)
        assert bytes(r.decoded) == (r.text or "").encode()


def test_empty_table_and_keep(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = bpe.decode(bpe.encode(df, PATH, PATTERN, keep=["doc_id"]), PATH, PATTERN)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.count() == 0


def test_ranks_are_the_library_kind():
    assert isinstance(bpe.encoder(PATH, PATTERN), tiktoken.Encoding)


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (bpe.CHUNK, bpe.OVERLAP)])
def test_decoded_beside_the_ids_equals_decode(spark, chunk, overlap):
    df = spark.createDataFrame([(i, t, "old", i) for i, t in enumerate(texts())], SCHEMA)
    how = {"chunk": chunk, "overlap": overlap}
    want = bpe.decode(bpe.encode(df, PATH, PATTERN, **how), PATH, PATTERN)
    got = bpe.encode(df, PATH, PATTERN, decoded="decoded", **how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
