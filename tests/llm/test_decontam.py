import random

from meshlens.llm import decontam
from meshlens.llm.common import words


def brute(own, items, window):
    hit, found = set(), set()
    for name, item in items:
        size = min(len(item), window)
        for i in range(len(item) - size + 1 if item else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == item[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(name)
    return hit, found


def cases():
    rng = random.Random(1)
    vocabulary = "a b c d E".split()
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 5, 9, 14])))) for i in range(10)]
    items += [(77, None), (10, items[4][1]), (11, "solo word"), (12, "One, two; three-four five SIX")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(60)]
    docs += [(90, None), (91, ""), (92, "!!"), (93, "x ONE two. three four five six y solo"), (93, "solo word")]
    return items, docs


def check(spark, window, block_words):
    items, docs = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' AS n_words", "1 AS text2")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(frame, bench, window=window, block_words=block_words).collect()
    assert len(got) == len(docs)
    plain = [(str(i), words(t)) for i, t in items]
    for r in got:
        own = words(r.text)
        hit, found = brute(own, plain, window)
        assert r.n_words == len(own)
        spans = list(zip(r.leak_spans[::2], r.leak_spans[1::2], strict=True))
        assert {k for a, b in spans for k in range(a, b)} == hit
        assert r.leak_items == sorted(found)


def test_equals_brute_force(spark):
    check(spark, 4, 10_000)


def test_blocks_and_long_items(spark):
    check(spark, 4, 12)


def test_remove(spark):
    docs = [(1, "please do keep, this! alpha beta gamma delta end.", 9), (2, "Alpha beta gamma delta", 9), (3, None, None), (4, "clean  text", 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame([(1, "alpha BETA gamma delta")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontam.remove_leaks(frame, bench).collect()}
    assert got == {1: ("please do keep, this!  end.", 27), 3: (None, None), 4: ("clean  text", 5)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert decontam.find_leaks(one, bench).collect()[0].leak_spans == []


def test_items_without_an_id_are_leaks_without_a_name(spark):
    long, short = "one two three four five six seven eight nine ten eleven", "alpha beta"
    items = [(None, long), (None, short), (None, None), (7, short)]
    docs = [(1, f"x {long} y"), (2, f"alpha {long.upper()} and alpha beta"), (3, "nothing of it"), (None, short)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (1000, 11):
        got = {r.doc_id: (r.leak_spans, r.leak_items) for r in decontam.find_leaks(frame, bench, block_words=block_words).collect()}
        assert got == {1: ([1, 12], []), 2: ([1, 12, 13, 15], ["7"]), 3: ([], []), None: ([0, 2], ["7"])}


def test_very_long_texts(spark):
    item = [f"w{k}" for k in range(30_000)]
    text = " ".join([*item, "x", *item])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontam.find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).head()
    assert got.leak_spans == [0, 30_000, 30_001, 60_001] and got.leak_items == ["1"]
