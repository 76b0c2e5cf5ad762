"""Line dedup against a plain version."""

import random

from meshlens.llm import linededup

DOCS = "doc_id long, text string, n_lines string, _id int"
A, Z = linededup.UPPER, linededup.LOWER


def plain(docs, least_chars=10, least_docs=2):
    low = str.maketrans(A, Z)
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(low)
    late = lambda i: (i is None, i or 0)
    holders = {}
    for i, t, *_ in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(late(i))
    out = []
    for i, t, *_ in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least_docs or min(holders[key(x)]) == late(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def corpus(seed, n):
    r = random.Random(seed)
    lines = ["", " ", "short", "exactly 10", "exactly 9", "Straße Ärger lang", "STRASSE ÄRGER LANG", "ÄRGER über alles", "a\tb  c d e f g"]
    lines += [f"shared line number {k}" for k in range(12)]
    docs = []
    for i in range(n):
        own = [f"line {i} {k} is unique" for k in range(3)]
        some = [r.choice(lines) for _ in range(r.randrange(6))] + own[: r.randrange(4)]
        some = [r.choice(("", " ", "\t", "\r", " ")) + (x.upper() if r.random() < 0.2 else x) + r.choice(("", "\r", "\x0b ")) for x in some]
        docs.append((r.randrange(n * 2), "\n".join(some), "x", 1))
    docs += [(None, "shared line number 3\nonly of no id\nonly of no id", "x", 1)] * 2 + [(None, "only of no id", "x", 1)]
    docs += [(7, None, "x", 1), (7, "", "x", 1), (8, "\n", "x", 1)] + [docs[0]] * 5
    return docs


def test_equals_plain_version(spark):
    for seed in range(2):
        docs = corpus(seed, 60)
        made = linededup.dedupe_lines(spark.createDataFrame(docs, DOCS).repartition(5))
        assert made.columns == ["doc_id", "text", "n_lines", "n_dropped"]
        assert got(made) == plain(docs)


def test_other_thresholds(spark):
    docs = corpus(5, 40)
    made = linededup.dedupe_lines(spark.createDataFrame(docs, DOCS), least_chars=3, least_docs=4)
    assert got(made) == plain(docs, 3, 4)


def test_hot_lines_and_repeated_rows(spark):
    docs = [(i, f"the same line in all of them\nown line of {i}", "x", 1) for i in range(400)]
    docs += [(5, "a row that is there very often\nthe same line in all of them", "x", 1)] * 300
    made = linededup.dedupe_lines(spark.createDataFrame(docs, DOCS).repartition(6))
    assert got(made) == plain(docs)


def test_very_long_text_and_empty_table(spark):
    many = "\n".join(f"line number {k // 2}" for k in range(200_000))
    docs = [(1, many, "x", 1), (2, many + "\nline of the second one", "x", 1), (3, "x" * 5_000_000, "x", 1), (4, " " + "X" * 5_000_000, "x", 1)]
    assert got(linededup.dedupe_lines(spark.createDataFrame(docs, DOCS))) == plain(docs)
    assert linededup.dedupe_lines(spark.createDataFrame([], DOCS)).collect() == []
