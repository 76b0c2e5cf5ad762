"""Filter audit against a plain version that runs every order document by document."""

import random
import re
from itertools import permutations

from meshlens.llm import audit

DOCS = "doc_id long, text string, source string, part string, row int"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, s, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        good = any(d is not None and d == i and q == 1 for d, q, _ in labels)
        toxic = any(d is not None and d == i and x == 1 for d, _, x in labels)
        rows.append((s or "", {f for f, bad in fails.items() if bad}, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = [r for r in rows if r[0] == part]
            gone = []
            for k, f in enumerate(order):
                hit = [r for r in alive if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                alive = [r for r in alive if f not in r[1]]
                gone += hit
                shares[f] += len(hit)
                alone = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, order, k + 1] = [len(alive), len(hit), redundant, alone, sum(r[2] for r in hit), sum(r[3] for r in hit)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shares[order[k - 1]])
    return {key: tuple(row) for key, row in out.items()}


def got(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def corpus(seed, n):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        words = [r.choice("abcdefghij") + str(r.randrange(r.choice((5, 500)))) for _ in range(r.choice((0, 20, 49, 50, 51, 90)))]
        if r.random() < 0.3:
            words = [w.upper() for w in words]
        if r.random() < 0.2:
            words.append(r.choice("#$%&*|"))
        docs.append((i, r.choice((" ", "\x0b", "  ", "\n")).join(words), r.choice(("web", "web", "book", "", None)), "p", 1))
    docs += [(n + k, docs[k][1], "web", "p", 1) for k in range(0, n, 3)]
    docs += [(5, "A b", "web", "p", 1), (5, docs[6][1], None, "p", 1), (None, docs[7][1], "web", "p", 1), (None, None, "web", "p", 1)]
    docs += [(10_000 + k, None, "hot", "p", 1) for k in range(40)] + [(3, docs[1][1], "hot", "p", 1)] * 20
    return docs


def test_equals_plain_version(spark):
    docs = corpus(1, 60)
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (5, 1, 1), (99_999, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    made = audit.audit(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS))
    found = got(made)
    assert found == plain(docs, labels)
    assert {k[0] for k in found} == {"web", "book", "", "hot"} and len(found) == 4 * 600
    assert made.columns == ["part", "filter_order", "step", *audit.MEASURES, "shapley"]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "x " * 60, "s", "p", 1)], DOCS)
    assert got(audit.audit(one, labels)) == plain([(1, "x " * 60, "s")], [])


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    docs = [(1, long, "s", "p", 1), (2, long, "s", "p", 1), (3, "w " * 300_000, "s", "p", 1)]
    found = got(audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)))
    assert found["s", "BEACD", 1][:3] == (2, 1, 0) and found["s", "BEACD", 2][:3] == (1, 1, 0)


def test_other_filters(spark):
    docs = [(1, "x", "s", "p", 1), (2, "x", "s", "p", 1), (3, "y", "s", "p", 1)]
    made = audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS), {"Y": lambda t: t == "y"})
    found = got(made)
    assert found["s", "EY", 1][:2] == (2, 1) and found["s", "EY", 2][:2] == (1, 1) and len(found) == 4


def test_no_python_in_the_plan(spark):
    docs, labels = spark.createDataFrame(corpus(2, 12), DOCS), spark.createDataFrame([], LABELS)
    plan = audit.audit(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
