import random

import numpy as np
import pytest

from meshlens.llm import jaccard
from meshlens.llm.common import plain_words


def grams(text, size=5):
    own = plain_words(text)
    width = min(size, len(own))
    return {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} if own else set()


def brute(docs):
    sets = [(i, grams(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, n=120):
    """Families of edited copies, shared passages, short texts, and texts of common words only."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    docs = []
    base = None
    for i in range(n):
        if base is None or rng.random() < 0.3:
            base = rng.choices(words, k=rng.choice([1, 3, 5, 7, 12, 40, 90]))
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            own[rng.randrange(len(own))] = rng.choice(words)
        text = " ".join(own)
        if rng.random() < 0.2:
            text += " " + passage
        docs.append((1000 - i, text.upper() if rng.random() < 0.2 else text))
    return docs + [(2000, ""), (2001, None), (2002, " \n\t "), (2003, passage), (2004, passage + " x")]


def joined(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS token", "2 AS n")
    return sorted(map(tuple, jaccard.join(frame).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    assert joined(spark, docs) == brute(docs)


def test_chains_over_common_shingles_need_all_rounds(spark, monkeypatch):
    """Links along a chain only, every shingle common: counters that all count as common."""
    monkeypatch.setattr(jaccard, "STARS", 0)
    rng = random.Random(9)
    own = [f"v{i}" for i in range(60)]
    docs = []
    for i in range(30):
        own = own[2:] + [f"n{i}a", f"n{i}b"]
        docs.append((i, " ".join(own)))
    rng.shuffle(docs)
    assert joined(spark, docs) == brute(docs)
    assert len({c for *_, c in brute(docs)}) == 1


def test_tree_walk_equals_set_overlap():
    rng = random.Random(3)
    common = np.zeros(jaccard.COUNTERS, bool)
    for _ in range(60):
        pool = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.choice([3, 12, 60]))], np.uint64))
        common[jaccard.counter(pool[::3])] = True

        def pick(pool=pool):
            return np.sort(np.array(rng.sample(pool.tolist(), max(1, int(len(pool) * rng.uniform(0.6, 1)))), np.uint64))

        query, others = pick(), [(str(i), pick()) for i in range(40)]
        want = {
            k
            for k, t in others
            if 100 * len(np.intersect1d(query, t)) >= 80 * len(np.union1d(query, t))
        }
        got = jaccard.overlap_links(jaccard.ordered(query, common), [(k, jaccard.ordered(t, common)) for k, t in others])
        assert set(got) == want and len(got) == len(want)


def test_repeats_nulls_and_empty(spark):
    text = "a b c d e f g"
    docs = [(5, text), (5, text), (None, text), (7, text), (None, None)]
    got = joined_rows = sorted(map(tuple, jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert joined_rows and got == sorted([(5, 3, 5), (5, 3, 5), (None, 3, 5), (7, 3, 5), (None, 0, None)], key=str)
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    text = "a b c d e f g"
    rows = [(5, text, 1), (5, text, 1), (None, text, 2), (7, text, 3), (8, "other words", 4), (9, None, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, count int")
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id, r["count"]) for r in kept.collect() if r.doc_id) == [(False, 5, 1), (False, 8, 4), (False, 9, 5)]
    assert kept.where("doc_id IS NULL").count() == 1


def test_groups_need_no_table_of_python_rows(spark, monkeypatch):
    frame = spark.createDataFrame(corpus(3, 40), "doc_id long, text string")
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert sorted(map(tuple, jaccard.join(frame).collect())) == brute(corpus(3, 40))
