import random

import numpy as np

from meshlens.llm import lzprint


def phrases(text):
    known, start, ends = set(), 0, []
    for end in range(1, len(text) + 1):
        if text[start:end] not in known:
            known.add(text[start:end])
            ends.append(end)
            start = end
    return known, ends


def texts():
    rng = random.Random(2)
    return ["", "a", "abab" * 20, "é🙂" * 9, *("".join(rng.choices("abcdé ", k=rng.randint(1, 400))) for _ in range(25))]


def test_parse_makes_the_dictionary_phrases(monkeypatch):
    for part in (3, 1 << 18):
        monkeypatch.setattr(lzprint, "PART", part)
        for t in texts():
            known = {}
            assert lzprint.parse(t, known, 0, 0).ends == phrases(t)[1]
            assert len(known) == len(phrases(t)[0])


class Counted(dict):
    """Known phrases that count how often they are asked."""

    asked = 0

    def get(self, *key):
        Counted.asked += 1
        return super().get(*key)

    def __contains__(self, key):
        Counted.asked += 1
        return super().__contains__(key)


def test_long_phrases_are_found_by_halving(monkeypatch):
    known = Counted()
    assert lzprint.parse("ab" * 50_000, known, 0, 0).ends == phrases("ab" * 50_000)[1]
    assert Counted.asked < 20_000  # of 100,000 code points
    for long in (1, 2, 5):
        monkeypatch.setattr(lzprint, "LONG", long)
        for t in [*texts(), "ab" * 300, "a" * 200 + "bcd" * 40, "\ud800" * 50]:
            assert lzprint.parse(t, {}, 0, 0).ends == phrases(t)[1]
            for cut in (1, 7, len(t) // 2):  # a text in two pieces
                known = {}
                first = lzprint.parse(t[:cut], known, 0, 0)
                assert first.ends + lzprint.parse(t[cut:], known, first.node, len(t[:cut])).ends == phrases(t)[1]


def test_hash_depends_on_the_phrase_alone():
    seen = {}
    for t in texts():
        ends = phrases(t)[1]
        for a, b, h in zip([0, *ends], ends, lzprint.hashes(t, 0, ends).tolist(), strict=False):
            assert seen.setdefault(t[a:b], h) == h
    assert len(set(seen.values())) == len(seen)


def fingerprint(text):
    return lzprint.as_text(lzprint.prints(text, len(text), "")[0])


def test_edited_print_equals_print_of_edited_text():
    own = texts()
    for a, b in zip(own, own[1:], strict=False):
        keep = len(a) - len(a) // 2
        print_a, edited = lzprint.prints(a, keep, b[: len(a) // 2])
        assert lzprint.as_text(edited) == fingerprint(a[:keep] + b[: len(a) // 2])
        assert lzprint.as_text(print_a) == fingerprint(a)


def test_likeness():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 40, 40).astype(np.uint64))
    none = np.zeros(0, np.uint64)
    assert lzprint.likeness(a, a) == 1 and lzprint.likeness(a, none) == 0 and lzprint.likeness(none, none) == 1
    assert lzprint.likeness(a, a[:20]) == 0.5


def test_query_equals_brute_force(spark):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts())]
    rows += [(200, None), (50, rows[3][1]), (None, "null id"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS range", "2 AS extra").repartition(3)
    got = lzprint.fingerprints(frame).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, (j, after) = t or "", order[(k + 1) % len(order)]
        after = after or ""
        keep = len(t) - len(t) // 2
        edited = t[:keep] + after[: len(t) // 2]
        near = lzprint.likeness(lzprint.prints(t, len(t), "")[0], lzprint.prints(after, len(after), "")[0])
        want.append((i, len(t), edited, fingerprint(t), fingerprint(edited), near, j))
    have = [(r.doc_id, r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, r.near_next, r.next_id) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_single_and_empty(spark):
    one = lzprint.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert [(r.edited, r.near_next, r.next_id) for r in one] == [("abab", 1.0, 1)]
    assert lzprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
