import random
import re

from meshlens.llm import repeats


def brute(docs):
    """Places to remove, from all units of all documents in order of id and place."""
    places = sorted(
        {(i is None, i or 0, a, b, plain) for i, t in docs for a, b, plain in repeats.units(t)}
    )
    kept, gone = {}, set()
    for none, i, a, b, plain in places:
        if plain not in kept:
            kept[plain] = (none, i)
        else:
            at = kept[plain]
            gone.add((None if none else i, a, b, None if at[0] else at[1]))
    return gone


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]

    def sentence(n=None):
        return " ".join(rng.choices(words, k=n or rng.randint(1, 14))).capitalize() + rng.choice([".", "!", "?"])

    common = sentence(9)
    passage = " ".join(sentence() for _ in range(9))
    docs = []
    for i in range(60):
        parts = [sentence() for _ in range(rng.randint(0, 12))]
        if i % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), passage.upper() if i % 8 else passage)
        if i % 5 == 0:
            parts += [common, common]
        text = ""
        for p in parts:
            text += p + rng.choice([" ", "\n", "  \n\t", " "])
        docs.append((100 - i, text))
    return docs, passage


def rows(frame):
    return {tuple(r) for r in repeats.repeated(frame).collect()}


def test_equals_brute_force(spark):
    docs, _ = corpus(3)
    docs += [(200, None), (201, ""), (None, docs[4][1]), (None, "no id here at all but six words"), (50, docs[50][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS k1")
    got = [tuple(r) for r in repeats.repeated(frame).collect()]
    assert set(got) == brute(docs) and len(got) == len(set(got))


def test_passages_inside_lines_are_found_and_clean_texts_left(spark):
    docs, passage = corpus(4)
    clean = (999, "This text stands nowhere else and says so in one long sentence. Short one. " * 1 + "Another sentence of some length follows here.")
    frame = spark.createDataFrame([*docs, clean], "doc_id long, text string")
    found = rows(frame)
    text = dict(docs)
    first = min(i for k, (i, _) in enumerate(docs) if k % 4 == 0)
    for k, (i, t) in enumerate(docs):
        if k % 4 == 0 and i != first:
            at = t.lower().index(passage.lower())
            hit = {p for d, a, b, _ in found if d == i for p in range(a, b)}
            lost = [p for p in range(at, at + len(passage)) if p not in hit and not t[p].isspace()]
            assert len(lost) < 0.4 * len(passage)
    assert not any(d == 999 for d, *_ in found)
    assert all(text[d][a:b].strip() == text[d][a:b] for d, a, b, _ in found)


def test_cleaned_documents_keep_offsets(spark):
    line = "One line of at least six words."
    docs = [(1, f"{line}\nOwn words stand here in this line too.", 1, "a"), (2, f"Start {line}  {line}\nend", 2, "b"), (3, line, 3, "c"), (4, None, None, "d"), (3, line, 3, "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars int, removed string")
    out = repeats.without_repeats(frame)
    assert out.columns == ["doc_id", "text", "n_chars", "removed"]
    got = sorted((r.doc_id, r.text, r.n_chars, r.removed) for r in out.collect() if r.text is not None)
    start = len(f"Start {line}  ")
    assert got == [
        (1, docs[0][1], 1, []),
        (2, f"Start {line}  \nend", len(f"Start {line}  \nend"), [start, start + len(line)]),
        (3, "", 0, [0, len(line)]),
        (3, "", 0, [0, len(line)]),
    ]


def test_units_do_not_depend_on_what_stands_before():
    text = "Alpha beta gamma delta epsilon zeta. Eta. Theta iota kappa lamda mu nu xi. End"
    tail = [u for *_, u in repeats.units("host words " + text)]
    assert tail[1:] == [u for *_, u in repeats.units(text)][1:]
    assert re.match("host words alpha", tail[0]) and repeats.units("") == [] == repeats.units("a b.\nc d")


def covered(host_words, passage, joint, seed):
    """Share of the passage's characters in units that two run-on hosts have in common, and the units' number."""
    rng = random.Random(seed)
    hosts = [joint.join(rng.choices(host_words, k=40)) for _ in range(4)]
    one, two = (joint.join([hosts[k], passage, hosts[k + 1]]) for k in (0, 2))
    shared = {u for *_, u in repeats.units(one)} & {u for *_, u in repeats.units(two)}
    at = one.index(passage)
    hit = {p for a, b, u in repeats.units(one) if u in shared for p in range(a, b)}
    assert all(at <= p < at + len(passage) for p in hit)
    return len(hit) / len(passage), len(shared)


def test_passages_between_places_without_a_full_stop_are_found():
    rng = random.Random(5)
    words, other = [f"w{i}" for i in range(500)], [f"v{i}" for i in range(500)]
    for n, least, some in ((50, 0.25, 0.9), (100, 0.6, 1), (300, 0.85, 1)):
        got = [covered(other, " ".join(rng.choices(words, k=n)), " ", k) for k in range(100)]
        assert sum(c for c, _ in got) / 100 > least and sum(n > 0 for _, n in got) / 100 >= some, (n, sum(c for c, _ in got), sum(n > 0 for _, n in got))


def test_scripts_without_spaces():
    rng = random.Random(6)
    han, other = [chr(0x4E00 + i) for i in range(400)], [chr(0x5E00 + i) for i in range(400)]
    got = [covered(other, "".join(rng.choices(han, k=200)), "", k) for k in range(50)]
    assert sum(c for c, _ in got) / 50 > 0.6 and all(n for _, n in got)
    line = "今天天气很好我们一起去公园散步吧。"
    assert [u for *_, u in repeats.units("他说的话我没有听见因为外面太吵了。" + line + "完")][1:] == [line]


def test_short_sentences_are_not_cut():
    for seed in range(300):
        text = " ".join(random.Random(seed).choices([f"w{i}" for i in range(99)], k=2 * repeats.REACH)) + "."
        assert len(repeats.units(text)) == 1
    long = repeats.units(" ".join(random.Random(1).choices([f"w{i}" for i in range(99)], k=5000)))
    assert min(len(u.split()) for *_, u in long) > repeats.REACH and len(long) > 200


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeated(frame).count() == 0 and repeats.without_repeats(frame).count() == 0
