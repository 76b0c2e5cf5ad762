import random

import numpy as np

from meshlens.llm import toxicity

INSULTS = "grubface snotling vilewretch".split()
PLAIN = [f"{a}{b}" for a in "qua rem sol tin ula vex".split() for b in "bo do fi go hu jo ka".split()]


def rows(seed, n, group=None):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = rng.random() < 0.3
        own = rng.choices(PLAIN, k=rng.randint(5, 60))
        if toxic:
            own += rng.choices(INSULTS, k=2)
        if group and (rng.random() < (0.8 if toxic else 0.05)):
            own.append(group)
        rng.shuffle(own)
        out.append((i, " ".join(own), int(toxic)))
    return out


def learn(spark, data, **how):
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    return toxicity.train(docs, labels, **how)


def test_held_out_accuracy_and_defined_cases(spark):
    data = rows(1, 500) + [(900, None, 1), (901, "", 0), (902, "unlabelled", None)]
    model = learn(spark, data)
    assert learn(spark, data).weights == model.weights
    frame = spark.createDataFrame(rows(2, 300) + [(950, None, 0), (951, "", 0)], "doc_id long, text string, y int")
    got = toxicity.score(frame.selectExpr("*", "'x' AS score"), model).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.y for r in got]) > 0.97
    assert len({r.score for r in got if r.doc_id in (950, 951)}) == 1


def test_mentions_of_groups_do_not_raise_scores(spark):
    data = rows(3, 600, group="muslims")
    biased, fair = learn(spark, data, fairness=0.0), learn(spark, data, fairness=20.0)
    texts = [t for _, t, y in rows(4, 100) if not y]
    rise = [np.mean([m.score(t + " muslims") - m.score(t) for t in texts]) for m in (biased, fair)]
    assert rise[1] < 0.5 * rise[0]
    assert np.mean([fair.score(t) >= 0.5 for _, t, y in rows(5, 100) if y]) > 0.9


def test_one_kind_of_label_and_empty(spark):
    model = learn(spark, [(1, "a", 0), (2, "b", 0)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert not model.weights and toxicity.score(empty, model).count() == 0
    assert learn(spark, []).score("x") == 0.5


def test_repeated_and_conflicting_labels(spark):
    data = rows(6, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data for _ in (0, 1)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.score(" ".join(INSULTS)) > 0.5 > model.score("quabo remdo")
