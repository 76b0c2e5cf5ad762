import re

from meshlens.llm import licenses
from meshlens.llm.common import words

TEXTS = [
    "Licensed under CC BY-NC 4.0.",
    "x This work is licensed under the GNU General Public License, version 3, or (at your option) any later version. gnu general public license",
    "Released under the terms of the MIT License! mit LICENSE",
    "licensed under the apache license 2 0",
    "licensed under the apache version license 2 0",
    "apache\nlicense; cc-by, cc bye",
    "Copyright (c) 2019 Some Body And Others. All rights reserved",
    "copyright " + "w " * 11 + "all rights reserved",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Work) to deal in the Work without restriction",
    "gnu general public gnu general public license license",
    "",
    None,
]


def test_equals_regular_expressions(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS * 2)), "doc_id long, text string").selectExpr("*", "'x' AS notices")
    got = licenses.scan(frame).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        own = [w.decode() for w in words(r.text)]
        joined = "".join(w + " " for w in own)
        places = sorted(
            i for p in licenses.PHRASES for i in range(len(own)) if own[i : i + len(p.split())] == p.split()
        )
        assert (r.n_words, sorted(r.base_places)) == (len(own), places)
        want = {label for label, t in licenses.TEMPLATES if re.search("(?:^| )" + licenses.as_regex(t), joined)}
        assert set(r.notices) == want, r.text
        assert set(r.base_labels) == {label for p, label in licenses.PHRASES.items() if p + " " in joined and places}
        for start, end in zip(r.notice_spans[::2], r.notice_spans[1::2], strict=True):
            part = "".join(w + " " for w in own[start:end])
            assert any(re.fullmatch(licenses.as_regex(t), part) for _, t in licenses.TEMPLATES)


def test_optional_and_replaceable_regions():
    made = licenses.Automaton([("t", False, "a [[b [[c]]]] {{1-2}} d")])

    def accepts(text):
        return [(s, e) for s, e, _ in made.scan(text.encode().split())[2]]

    assert accepts("a x d") == [(0, 3)] and accepts("a b x d") == [(0, 4)] and accepts("a b c x y d") == [(0, 6)]
    assert accepts("a d") == [] and accepts("a x y z d") == [] and accepts("a d d") == [(0, 3)]


def whole(wording):
    """A template as a text: optional regions left out, replaceable ones filled as shortly as may be."""
    while "[[" in wording:
        wording = re.sub(r"\[\[[^\[\]]*\]\]", "", wording)
    return re.sub(r"\{\{(\d+)-\d+\}\}", lambda m: "thing " * int(m[1]), wording)


LONG = [label for label, t in licenses.TEMPLATES if len(t.split()) > 60]


def test_whole_wordings_are_told_apart(spark):
    """Every licence text has its own label; with one mandatory word changed anywhere it is not accepted."""
    assert len(LONG) == 8
    made = licenses.automaton(tuple((label, False, t) for label, t in licenses.TEMPLATES if label in LONG))
    for label in LONG:
        own = whole(dict(licenses.TEMPLATES)[label]).split()
        fixed = [i for i, w in enumerate(own) if w != "thing" and own[i - 1] != "thing"]
        encoded = [w.encode() for w in ["before", *own, "after"]]
        assert made.scan(encoded)[2] == [(1, 1 + len(own), label)], label
        for i in fixed[:1] + fixed[5::7] + fixed[-1:]:
            other = [*encoded[: i + 1], b"changed", *encoded[i + 2 :]]
            assert made.scan(other)[2] == [], (label, i, own[i])


def test_a_text_with_a_clause_left_out(spark):
    three = whole(dict(licenses.TEMPLATES)["bsd-3-clause"])
    cut = three.replace("redistributions in binary form must reproduce the above copyright notice", "")
    wrapped = "/* " + three.upper().replace(" ", "\n * ", 40) + " */"
    frame = spark.createDataFrame([(1, three), (2, cut), (3, wrapped), (4, "x " * 200_000 + three)], "doc_id long, text string")
    got = {r.doc_id: r.notices for r in licenses.scan(frame).collect()}
    assert got == {1: ["bsd-3-clause"], 2: [], 3: ["bsd-3-clause"], 4: ["bsd-3-clause"]}


def test_remembered_states_have_a_bound(monkeypatch):
    monkeypatch.setattr(licenses, "MOST_STATES", 3)
    made = licenses.Automaton([("t", False, "a [[b [[c]]]] {{1-9}} d")])
    for k in range(9):
        own = b"a " + b" ".join(b"w%d" % i for i in range(k)) + b" d"
        assert bool(made.scan(own.split())[2]) == (k >= 1)
        assert len(made.known) <= 3 and all(len(row) <= 5 for row in made.known.values())


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
