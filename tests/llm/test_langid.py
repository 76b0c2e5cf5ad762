import random

import numpy as np

from meshlens.llm import langid

SYLLABLES = {"xx": "ba bo be bu lam nor".split(), "yy": "zi ze kri tsch vor".split(), "zz": "ña ño lli rra que".split()}


def text(lang, rng, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def rows(seed, n):
    rng = random.Random(seed)
    return [(i, text(k, rng), k) for i in range(n) for k in [rng.choice(sorted(SYLLABLES))]]


def test_held_out_accuracy_and_defined_cases(spark):
    schema = "doc_id long, text string, lang string"
    learned = rows(1, 300) + [(900, None, "xx"), (901, "", "yy"), (902, "123 !!", "zz"), (903, "ba bo", None)]
    model = langid.train(spark.createDataFrame(learned, schema))
    assert model.languages == ["xx", "yy", "zz"] and 0 < model.temperature <= 5
    odd = [(500, None, None), (501, "", "xx"), (502, "12 34 ?!", "xx"), (503, text("yy", random.Random(5), 60_000), "yy")]
    frame = spark.createDataFrame(rows(2, 200) + odd, schema).selectExpr("*", "7 AS score", "'q' AS lang_pred")
    got = langid.predict(frame, model).collect()
    assert len(got) == 204
    known = [r for r in got if r.doc_id < 500 or r.doc_id == 503]
    assert np.mean([r.lang == r.lang_pred for r in known]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (500, 501, 502)} == {("und", 0.0)}


def test_nothing_to_learn_and_empty(spark):
    schema = "text string, lang string"
    model = langid.train(spark.createDataFrame([("abc", None)], schema))
    assert langid.predict(spark.createDataFrame([("abc", None)], schema), model).collect()[0].lang_pred == "und"
    model = langid.train(spark.createDataFrame([], schema))
    assert langid.predict(spark.createDataFrame([], schema), model).count() == 0


def test_grams_do_not_depend_on_parts(monkeypatch):
    value = "Some Words, and 12 more: ñandú " * 20
    whole = langid.grams(value)
    monkeypatch.setattr(langid, "PART", 7)
    parts = langid.grams(value)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_sample_is_bounded(spark):
    frame = spark.createDataFrame(rows(4, 400), "doc_id long, text string, lang string")
    model = langid.train(frame, sample=30)
    got = langid.predict(frame, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_copies_count_once_in_the_sample(spark):
    texts = [("same", "xx")] * 3000 + [(None, "yy")] * 3000 + [(f"t{k}", k) for k in ("xx", "yy") for _ in range(9)] + [(f"t{i}", "xx") for i in range(500)]
    known = spark.createDataFrame(texts, "text string, lang string").repartition(5)
    for sample in (5, 40, 1000):
        got = [tuple(r) for r in langid.sampled(known, {"xx": 502, "yy": 2}, sample).collect()]
        assert len(set(got)) == len(got) and set(got) <= set(texts)
        assert [sum(k == lang for _, k in got) for lang in ("xx", "yy")] == [min(502, sample), 2]
    frame = spark.createDataFrame([*rows(6, 200), *[(900, "ba bo be", "xx"), (901, None, "zz")] * 1500], "doc_id long, text string, lang string")
    got = langid.predict(spark.createDataFrame(rows(7, 100), frame.schema), langid.train(frame, sample=30)).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
