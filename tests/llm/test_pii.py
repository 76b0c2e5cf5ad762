import hashlib
import random
import re

from pyspark.sql import functions as F

from meshlens.llm import pii

KEY = "k"
ALNUM = re.compile(r"[^\W_]")


def stream(kind, norm, attempt=0):
    text = f"{KEY}|{kind}|{norm}|{attempt}"
    hexes = "".join(hashlib.sha256(f"{text}|{n}".encode()).hexdigest() for n in (0, 1))
    return [int(hexes[2 * i : 2 * i + 2], 16) for i in range(64)]


def swapped(text, own):
    out = []
    for i, c in enumerate(text):
        alphabet = next((a for a in pii.ALPHABETS if c in a), None)
        out.append(alphabet[own[i % 64] % len(alphabet)] if alphabet else "x" if c.isalpha() else c)
    return "".join(out)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def filled(entity, plain):
    size = len(ALNUM.findall(entity))
    rest = iter(plain[len(plain) - size :])
    return "".join(next(rest) if ALNUM.match(c) else c for c in entity)


def brute(kind, entity):
    plain = "".join(ALNUM.findall(entity))
    if kind == "email":
        low = entity.lower()
        local, domain = low.split("@")
        head, top = domain.rsplit(".", 1)
        mail = swapped(local, stream("email", low)) + "@" + swapped(head, stream("domain", domain)) + "." + top
        return "".join(n.upper() if c.isupper() else n for c, n in zip(entity, mail, strict=True))
    if kind == "ip":
        own = [str(b % 254 + 1) for b in stream("ip", entity)]
        private = re.match(r"10\.|127\.|192\.168\.|", entity)[0]
        return private + ".".join(own[: 4 - private.count(".")])
    if kind == "phone":
        norm = "1" + plain if len(plain) == 10 and entity[0] != "+" else plain
        code = 1 if norm[0] == "1" else 2
        return filled(entity, norm[:code] + swapped(norm[code:], stream("phone", norm)))
    if kind == "card":
        body = plain[0] + swapped(plain[1:-1], stream("card", plain))
        return filled(entity, body + next(str(d) for d in range(10) if luhn(body + str(d)) == luhn(plain)))
    if kind == "ssn":
        return filled(entity, swapped(plain, stream("ssn", plain)))
    return "".join(f"{b % 16:x}" for b in (stream("secret", entity) * 2)[: len(entity)])


CASES = [
    ("email", "Jo.Doe+x@Mail.example.org"),
    ("email", "élan_7@sub.bücher.example"),
    ("ip", "97.51.17.173"),
    ("ip", "192.168.3.4"),
    ("phone", "+1 (017) 555-7713"),
    ("phone", "(017) 555-7713"),
    ("phone", "+49 30 1234 5678"),
    ("card", "9807915762804490"),
    ("card", "4111-1111-1111-1111"),
    ("card", "3782 822463 10005"),
    ("ssn", "078-05-1120"),
    ("secret", "1eb9c654e721b4f812088970e66a6345cee33dd6"),
]


def run(spark, texts, **how):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = pii.pseudonymise(frame, KEY, found="kinds", **how)
    return {r.doc_id: r for r in made.collect()}


def test_types_equal_brute_force(spark):
    got = run(spark, [f"see {e}, {e}." for _, e in CASES])
    for k, (kind, e) in enumerate(CASES):
        assert got[k].kinds == [kind, kind], e
        assert got[k].text == f"see {brute(kind, e)}, {brute(kind, e)}."
        assert e not in got[k].text


def test_same_entity_in_other_writing(spark):
    got = run(spark, ["+1 (017) 555-7713", "(017) 555-7713", "4111 1111 1111 1111", "4111111111111111"])
    digits = ["".join(filter(str.isdigit, got[k].text)) for k in range(4)]
    assert digits[0] == "1" + digits[1] and digits[2] == digits[3] and luhn(digits[2]) == 0


def test_names_follow_gender_script_and_person(spark):
    got = run(spark, ["Mrs. Anna Miller met Mr Miller", "Frau Miller", "Госпожа Анна Иванова", "MR SMITH no", "Herr MILLER"])
    first = re.fullmatch(r"Mrs\. ([A-Z][a-z]+a) ([A-Z][a-z]+) met Mr ([A-Z][a-z]+)", got[0].text)
    assert first and first[2] == first[3] and got[1].text == f"Frau {first[2]}" and got[4].text == f"Herr {first[2].upper()}"
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+а [А-Я][а-я]+", got[2].text) and got[3].text == "MR SMITH no"
    assert not {"Anna", "Miller"} & set(re.findall(r"\w+", got[0].text))


def test_accounts_stay_valid(spark):
    text = run(spark, ["DE89 3704 0044 0532 0130 00"])[0].text
    assert re.fullmatch(r"DE\d\d(?: \d{4}){4} \d\d", text) and text != "DE89 3704 0044 0532 0130 00"
    plain = text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_collisions_are_drawn_anew(spark):
    """600 surnames share about 4,000 first stand-ins: several must collide."""
    rng = random.Random(2)
    names = sorted({"".join(rng.choices("abcdefghij", k=7)).title() for _ in range(600)})
    texts = [f"Mr {a} and Mrs {b}" for a, b in zip(names, names[1:], strict=False)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.drawn_anew(frame, KEY, "text").count() > 3
    got = run(spark, texts)
    chosen = {}
    for k, (a, b) in enumerate(zip(names, names[1:], strict=False)):
        x, y = re.fullmatch(r"Mr (\S+) and Mrs (\S+)", got[k].text).groups()
        assert chosen.setdefault(a, x) == x and chosen.setdefault(b, y) == y
    assert len(set(chosen.values())) == len(chosen) and not set(chosen.values()) & set(chosen)


def test_phone_numbers_of_the_languages_served(spark):
    numbers = ["+33 1 23 45 67 89", "+33 6 12 34 56 78", "+33\u00a06\u202f12 34 56 79", "+33 (0)1 23 45 67 88", "+7 912 345 67 89", "+7 (912) 345-67-80"]
    numbers += ["+79123456781", "1-800-555-1234", "1 (800) 555-1235", "+358 9 123 4567", "+49 30 1234 5678", "+1 (800) 555-1236"]
    got = run(spark, [f"see {n}, {n}; not {n[-1]}." for n in numbers])
    for k, (n, code) in enumerate(zip(numbers, "33 33 33 33 7 7 7 1 1 358 49 1".split(), strict=True)):
        assert got[k].kinds == ["phone", "phone"], n
        one, two = re.fullmatch(rf"see (.+), (.+); not {n[-1]}\.", got[k].text).groups()
        assert one == two != n and re.sub(r"\d", "0", one) == re.sub(r"\d", "0", n)
        plain = "".join(filter(str.isdigit, n))
        own = stream("phone", plain)
        assert "".join(filter(str.isdigit, one)) == code + swapped(plain[len(code) :], own)


def test_numbers_beside_a_phone_number_stay(spark):
    got = run(spark, ["+49 30 1234 5678 2020 1999", "+33 6 12 34 56 78 123456", "+7 10 20 30 and 1-800 and 21-800-555-1234"])
    assert got[0].text.endswith(" 2020 1999") and got[1].text.endswith(" 123456") and got[0].kinds == got[1].kinds == ["phone"]
    assert "12 34 56 78" not in got[1].text and got[2].kinds == []


def test_other_writings_of_a_phone_number(spark):
    got = run(spark, ["1-800-555-1234", "(800) 555-1234", "+1 800 555 1234", "+33 6 12 34 56 78", "+33612345678", "+33 6 12 34 56 79"])
    plain = ["".join(filter(str.isdigit, got[k].text)) for k in range(6)]
    assert plain[0] == plain[2] == "1" + plain[1] and plain[3] == plain[4] != plain[5]


def settled(spark, texts):
    """Texts after replacement, all different and none of them an original."""
    got = run(spark, texts)
    out = [got[k].text for k in range(len(texts))]
    assert len(set(out)) == len(out) and not set(out) & set(texts)
    return out


def test_redraw_ends_where_nothing_can_be_swapped_or_values_are_few(spark):
    texts = ["_@foo.com", "-@foo.com", "李小@foo.com", "王明@foo.com", "a@李.com", "a@王.com", "A@-.COM"]
    texts += [f"{d}@few.com" for d in range(10)] + [f"a@{c}.net" for c in "abcdefghijklmnopqrstuvwxyz"]
    out = settled(spark, texts)
    assert all(re.fullmatch(pii.PATTERNS[0][1].replace(r"\p{L}\p{N}", r"\w").replace(r"\p{L}", r"[^\W\d]"), x) for x in out)
    assert not any(c in x for x in out for c in "李小王明") and re.fullmatch(r"[A-Z]@-[a-z]+\.COM", out[6])


def test_later_draws_grow_or_leave_the_private_range(spark):
    rows = [("ip", "192.168.3.4"), ("ip", "10.1.2.3"), ("phone", "10175557713"), ("ssn", "078051120"), ("email", "_@a.b")]
    units = spark.createDataFrame(rows, "kind string, norm string").crossJoin(spark.range(40).withColumnRenamed("id", "attempt"))
    made = units.withColumn("new", pii.stand_in(KEY, units["kind"], units["norm"], units["attempt"])).collect()
    new = {(r.kind, r.norm, r.attempt): r.new for r in made}
    assert [new["ip", "192.168.3.4", k].startswith(p) for k, p in ((7, "192.168."), (8, "10."), (15, "10."))] == [True] * 3
    assert new["ip", "10.1.2.3", 15].startswith("10.") and re.fullmatch(r"\d+(\.\d+){3}", new["ip", "192.168.3.4", 31])
    assert re.fullmatch(r"fd[0-9a-f]{2}(:[0-9a-f]{4}){7}", new["ip", "10.1.2.3", 32])
    assert [len(new["phone", "10175557713", k]) for k in (0, 7, 8, 10)] == [11, 11, 12, 14]
    assert [len(new["ssn", "078051120", k]) for k in (0, 7, 8)] == [9, 9, 10]
    assert len({new["email", "_@a.b", k] for k in range(2, 40)}) == 38
    shown = pii.written_as(F.lit("(017) 555-7713"), F.lit("10175557713"), F.lit("1234567890123"))
    assert spark.range(1).select(shown).first()[0] == "(234) 567-890123"


def test_clean_text_nulls_and_clashing_columns(spark):
    rows = [(1, None, None, 1, "a"), (2, "", 0, 2, "b"), (3, "Don. La 12 3.4.5 x@y 2020-01-02 v1.2.3", 7, 3, "c"), (4, "a 1.2.3.4 b", 11, 4, "d"), (4, "a 1.2.3.4 b", 11, 4, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, kind int, norm string")
    got = pii.pseudonymise(frame, KEY)
    assert got.columns == frame.columns and got.schema["n_chars"].dataType == frame.schema["n_chars"].dataType
    back = sorted(map(tuple, got.collect()), key=repr)
    assert back[:3] == [tuple(r) for r in rows[:3]]
    assert back[3] == back[4] and back[3][1] == f"a {brute('ip', '1.2.3.4')} b" and back[3][2] == len(back[3][1])
    assert pii.pseudonymise(frame.limit(0), KEY).count() == 0


def test_no_python_on_executors(spark):
    plan = pii.pseudonymise(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string"), KEY)
    assert "Python" not in (text := plan._jdf.queryExecution().toString()) and "Arrow" not in text
