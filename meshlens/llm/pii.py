"""Surrogates for personal data, made with DataFrame functions only.

Detected entities (mail addresses, secrets, IP addresses, phone numbers, social security numbers,
bank accounts, cards, names after a form of address) get replacements derived from a key:

* of the same type and format: every character gives one of its own alphabet (so the script stays),
  separators and case stay, a country code, top-level domain or form of address stays, a card keeps
  its Luhn remainder, an account gets right check digits, an IP address stays one; names follow
  the gender of the form of address;
* the same for every mention of an entity, however it is written (``coreference``);
* different for different entities, and never an entity that itself occurs: stand-ins that collide
  anywhere in the corpus are drawn anew until none does. They grow with the attempts: mail addresses
  and domains from the third draw on, phone and social security numbers from the ninth; from the ninth
  on private networks leave their range, and after 32 draws an IP address becomes a private IPv6 one,
  which no detected address equals. So a free stand-in is always found.

Only the distinct entities are compared with each other; documents are not shuffled, unless some
stand-in was drawn anew. NULL and empty texts stay as they are, and so does all text outside of
entities, byte for byte. Rows are neither dropped nor merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import let, stored

_FEMALE = r"Mrs|Ms|Mme|Mlle|Madame|Frau|Sra|Señora|Señorita|Госпожа"
_MALE = r"Mr|Monsieur|Herr|Sr|Señor|Господин"
_TITLE = r"(?:(?:Mrs|Ms|Mr|Mme|Mlle|Sra|Sr)\.?|Madame|Frau|Señora|Señorita|Госпожа|Monsieur|Herr|Señor|Господин)"
_NAME = r"\p{Lu}[\p{L}'’\-]{1,30}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Between the groups of a phone number; also the spaces that French writing keeps together.
_SEP = "[ .\\-\u00a0\u202f]"
_GAP = "[() .\\-\u00a0\u202f]"
#: A country code; +7 has ten digits behind it. A number has at most 15 digits.
_CODE = rf"(?:7(?={_GAP}{{0,2}}(?:\d{_GAP}{{0,2}}){{9}}\d)|(?!1)\d{{2,3}})"
_MOST = r"(?<!\d" + rf"{_GAP}{{0,2}}\d" * 15 + ")"  # spelled out: no loops of groups behind
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Type and pattern, tried in this order at every place.
PATTERNS = [
    ("email", r"[\p{L}\p{N}._%+\-]{1,64}@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}"),
    ("secret", r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![\p{L}\p{N}])"),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    ("phone", rf"(?<![\p{{L}}\p{{N}}])\+1{_SEP}?\(?\d{{3}}\)?{_SEP}?\d{{3}}{_SEP}?\d{{4}}(?!\d)"),
    ("phone", rf"(?<![\p{{L}}\p{{N}}])\+{_CODE}{_SEP}?(?:\(0\){_SEP}?)?\(?\d{{1,4}}\)?(?:{_SEP}?\d{{2,4}}){{2,5}}(?!\d){_MOST}"),
    ("phone", rf"(?<![\p{{L}}\p{{N}}.+\-])(?:1{_SEP})?(?:\(\d{{3}}\) ?|\d{{3}}[.\-])\d{{3}}[.\-]\d{{4}}(?!\d)"),
    ("ssn", r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("card", r"(?<!\d)(?:\d{4}[ \-]?){3}\d{4}(?!\d)|(?<!\d)3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}(?!\d)"),
    ("name", rf"(?<!\p{{L}}){_TITLE} {_NAME}(?: {_NAME})?"),
]
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Every entity has one of these in it; a text without any is not searched further.
HINT = rf"[0-9@]|AKIA|gh[pousr]_|sk-|{_TITLE} \p{{Lu}}"
#: Draws before numbers grow and private networks leave their range, and before IPv4 is left.
SAME_SIZE, IPV4 = 8, 32
#: Alphabets; a character is replaced by one of its own.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
#: Syllables of made-up names, by script, and their endings by kind of name.
SYLLABLES = {
    "latin": "ba be bo da de di fa ga ka ke la le li lo ma me mi na ne no ra re ri ro sa se so ta te ti va vi".split(),
    "cyrillic": "ба бе бо да де ди га ка ла ле ли ло ма ме ми на не но ра ре ри ро са се со та те ти ва ви ве".split(),
}
ENDINGS = {
    "latin": {"female": "na la ra da".split(), "male": "n l r d".split(), "surname": "ner son ton ler".split()},
    "cyrillic": {"female": "на ла ра да".split(), "male": "н л р д".split(), "surname": "ко енко ич ук".split()},
}
_ALNUM = r"[^\p{L}\p{N}]"


def chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that key, entity and attempt determine."""
    text = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(text, F.lit("|0")), 256), F.sha2(F.concat(text, F.lit("|1")), 256))


def byte(digits: Column, i: Column | int) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) % 64 * 2 + 1
    return F.conv(F.substr(digits, at, F.lit(2)), 16, 10).cast("int")


def pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), number % len(values))


def swapped(x: Column, digits: Column, attempt: Column) -> Column:
    """Each character of an alphabet replaced by another of it; other letters and digits by ``x``, drawn anew by any."""

    def one(c: Column, i: Column) -> Column:
        other = F.when(attempt == 0, F.lit("x")).otherwise(F.substr(F.lit(ALPHABETS[1]), byte(digits, i) % 26 + 1, F.lit(1)))
        out = F.when(c.rlike(r"[\p{L}\p{N}]"), other).otherwise(c)
        for alphabet in ALPHABETS:
            new = F.substr(F.lit(alphabet), byte(digits, i) % len(alphabet) + 1, F.lit(1))
            out = F.when(F.lit(alphabet).contains(c), new).otherwise(out)
        return out

    return F.array_join(F.transform(chars(x), one), "")


def kind_of(entity: Column) -> Column:
    """Type of a detected entity."""
    out = F.lit("card")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def units(entity: Column) -> Column:
    """What of an entity is replaced as one: ``kind, norm`` each."""

    def unit(kind: Column | str, norm: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), norm.alias("norm"))

    plain = F.regexp_replace(entity, _ALNUM, "")
    digits = F.when((F.length(plain) == 10) & ~entity.startswith("+"), F.concat(F.lit("1"), plain)).otherwise(plain)
    low = F.lower(entity)
    words = F.split(F.regexp_replace(entity, rf"^{_TITLE} ", ""), " ")
    gender = F.when(entity.rlike(rf"^(?:{_FEMALE})\b"), "female").otherwise("male")
    last = unit("surname", F.lower(F.element_at(words, -1)))
    names = F.when(F.size(words) > 1, F.array(unit(gender, F.lower(F.get(words, F.lit(0)))), last)).otherwise(F.array(last))

    def of(kind: Column) -> Column:
        return (
            F.when(kind == "email", F.array(unit("email", low), unit("domain", F.substring_index(low, "@", -1))))
            .when(kind == "name", names)
            .when(kind == "phone", F.array(unit(kind, digits)))
            .when(kind == "ip", F.array(unit(kind, entity)))
            .otherwise(F.array(unit(kind, F.when(kind == "secret", entity).otherwise(plain))))
        )

    return let(kind_of(entity), of)


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10; the last digit counts once."""
    size = F.length(digits)

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((size - i) % 2 == 1, d).otherwise(twice)

    return F.aggregate(F.transform(chars(digits), worth), F.lit(0), lambda a, x: a + x) % 10


def checked_account(country: Column, rest: Column) -> Column:
    """An account number with right check digits (ISO 7064, modulo 97)."""

    def step(a: Column, c: Column) -> Column:
        value = F.when(c.rlike(r"\d"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (a * F.when(value > 9, 100).otherwise(10) + value) % 97

    text = F.concat(rest, country, F.lit("00"))
    remainder = F.aggregate(chars(text), F.lit(0), step)
    return F.concat(country, F.lpad((98 - remainder).cast("string"), 2, "0"), rest)


def stand_in(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The replacement of a unit in plain form: without separators, in lower case."""

    def made(digits: Column) -> Column:
        local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
        top = F.regexp_extract(norm, r"(\.[^.]+)$", 1)
        head = F.substr(norm, F.lit(1), F.length(norm) - F.length(top))
        octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (byte(digits, i) % 254 + 1).cast("string"))
        own = F.regexp_extract(norm, r"^(10\.|127\.|192\.168\.)", 1)  # private networks stay private
        wide = F.when((attempt < 2 * SAME_SIZE) & (own != ""), "10.").otherwise("")  # while there is room
        octet = F.when(attempt < SAME_SIZE, own).otherwise(wide)
        address = F.concat(octet, F.array_join(F.slice(octets, 1, F.when(octet == "", 4).when(octet == "192.168.", 2).otherwise(3)), "."))
        sixth = F.regexp_replace(F.concat(F.lit("fd"), F.substr(digits, F.lit(1), F.lit(30))), "(.{4})(?!$)", "$1:")
        address = F.when(attempt < IPV4, address).otherwise(sixth)
        fresh = swapped(F.substr(norm, F.lit(2), F.length(norm) - 2), digits, attempt)
        fifteen = F.concat(F.substr(norm, F.lit(1), F.lit(1)), fresh)
        card = F.concat(fifteen, ((luhn(norm) - luhn(F.concat(fifteen, F.lit("0"))) + 10) % 10).cast("string"))
        code = F.length(F.regexp_extract(norm, _COUNTRY, 1))
        phone = F.concat(F.substr(norm, F.lit(1), code), swapped(grown(F.substr(norm, code + 1, F.length(norm)), "0", SAME_SIZE), digits, attempt))
        prefix = F.regexp_extract(norm, r"^(AKIA|gh[pousr]_|sk-|)", 1)
        hexed = F.array_join(
            F.transform(F.sequence(F.lit(0), F.length(norm) - 1), lambda i: F.lower(F.hex((byte(digits, i) % 16).cast("long")))), ""
        )
        secret = F.when(prefix == "", hexed).otherwise(F.concat(prefix, swapped(F.substr(norm, F.length(prefix) + 1, F.length(norm)), digits, attempt)))
        account = checked_account(F.substr(norm, F.lit(1), F.lit(2)), swapped(F.substr(norm, F.lit(5), F.length(norm)), digits, attempt))
        out = F.when(kind == "email", F.concat(swapped(grown(local, "x", 2), digits, attempt), F.lit("@"), domain))
        out = out.when(kind == "domain", F.concat(swapped(grown(head, "x", 2), digits, attempt), top))
        out = out.when(kind == "ip", address).when(kind == "card", card).when(kind == "phone", phone)
        out = out.when(kind == "iban", account).when(kind == "secret", secret).when(kind == "ssn", swapped(grown(norm, "0", SAME_SIZE), digits, attempt))
        return out.otherwise(made_up(digits))

    def grown(x: Column, by: str, start: int) -> Column:
        """``x`` with a character more at every attempt from ``start`` on."""
        return F.concat(x, F.repeat(F.lit(by), F.greatest(attempt.cast("int") - start + 1, F.lit(0))))

    def made_up(digits: Column) -> Column:
        return F.when(norm.rlike(r"\p{IsCyrillic}"), named("cyrillic", digits)).otherwise(named("latin", digits))

    def named(script: str, digits: Column) -> Column:
        places = F.sequence(F.lit(0), attempt.cast("int") + 1)
        body = F.transform(places, lambda i: pick(SYLLABLES[script], byte(digits, i)))
        end = F.lit("")
        for sort, endings in ENDINGS[script].items():
            end = F.when(kind == sort, pick(endings, byte(digits, 63))).otherwise(end)
        return F.concat(F.array_join(body, ""), end)

    return let(stream(key, kind, norm, attempt), made)


def written_as(entity: Column, norm: Column, plain: Column) -> Column:
    """``plain`` put in the places of the letters and digits of ``entity``, which may lack the first ones of its
    ``norm``; what ``plain`` has grown by stands behind."""
    left_out = F.length(norm) - F.length(F.regexp_replace(entity, _ALNUM, ""))

    def one(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), _ALNUM, ""))
        new = F.substr(plain, left_out + place, F.lit(1))
        return F.when(c.rlike(_ALNUM), c).otherwise(new)

    behind = F.substr(plain, F.length(norm) + 1, F.length(plain))
    return F.concat(F.array_join(F.transform(chars(entity), one), ""), behind)


def mail_parts(mail: Column) -> Column:
    """Local part, domain head and top-level domain."""
    return F.split(mail, r"@|\.(?=[^.@]*$)")


def cased_as(entity: Column, plain: Column) -> Column:
    """``plain`` with capitals where ``entity`` has them."""
    own = chars(entity)
    return F.array_join(
        F.transform(chars(plain), lambda c, i: F.when(F.lower(F.get(own, i)) != F.get(own, i), F.upper(c)).otherwise(c)), ""
    )


def surrogate(key: str, entity: Column, attempts: Column) -> Column:
    """The replacement of an entity as it is written in the text."""

    def drawn(unit: Column) -> Column:
        again = F.coalesce(F.get(F.map_values(F.map_filter(attempts, lambda k, _: k == unit_name(unit))), F.lit(0)), F.lit(0))
        return stand_in(key, unit["kind"], unit["norm"], again)

    def put(parts: Column, found: Column) -> Column:
        kind = F.get(parts, F.lit(0))["kind"]
        first, last = F.get(found, F.lit(0)), F.element_at(found, -1)
        sides = F.arrays_zip(mail_parts(entity).alias("e"), mail_parts(F.concat(F.substring_index(first, "@", 1), F.lit("@"), last)).alias("f"))
        mail = F.transform(sides, lambda p: cased_as(p["e"], p["f"]))
        mail = F.concat(F.get(mail, F.lit(0)), F.lit("@"), F.get(mail, F.lit(1)), F.lit("."), F.get(mail, F.lit(2)))
        title = F.regexp_extract(entity, rf"^({_TITLE}) ", 1)
        words = F.split(F.regexp_replace(entity, rf"^{_TITLE} ", ""), " ")
        named = F.transform(F.arrays_zip(words.alias("w"), found.alias("f")), lambda p: F.when((F.upper(p["w"]) == p["w"]) & (F.length(p["w"]) > 1), F.upper(p["f"])).otherwise(F.initcap(p["f"])))
        name = F.concat_ws(" ", title, F.array_join(named, " "))
        out = F.when(kind == "email", mail).when(kind.isin("female", "male", "surname"), name)
        return out.when(kind.isin("ip", "secret"), first).otherwise(written_as(entity, F.get(parts, F.lit(0))["norm"], first))

    return let(units(entity), lambda parts: let(F.transform(parts, drawn), lambda found: put(parts, found)))


def unit_name(unit: Column) -> Column:
    return F.concat_ws(":", unit["kind"], unit["norm"])


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def found_entities(docs: DataFrame, text: str) -> DataFrame:
    """``__pii_key, entity``: the entities of every text, found once and stored."""
    hinted = docs.where(F.col(text).rlike(HINT))
    found = hinted.select(digest_of(F.col(text)).alias("__pii_key"), F.explode(entities(F.col(text))).alias("entity"))
    return stored(found.distinct(), "pii-entities")


def drawn_anew(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``unit, attempt`` of the units whose first stand-in collides with another or with an original."""
    return redrawn(found_entities(docs, text), key)


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """:func:`drawn_anew` for the entities found."""
    found = found.select("entity").distinct()
    own = stored(found.select(F.explode(units(F.col("entity"))).alias("u")).select("u.kind", "u.norm").distinct(), "pii-units")
    now = own.withColumn("attempt", F.lit(0))
    taken = own.select("kind", F.col("norm").alias("new"), F.lit(True).alias("real"))
    while True:
        drawn = now.withColumn("new", stand_in(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        winners = drawn.groupBy("kind", "new").agg(F.min("norm").alias("winner"))
        marked = drawn.join(winners, ["kind", "new"]).join(taken, ["kind", "new"], "left")
        lost = F.col("real").isNotNull() | (F.col("norm") != F.col("winner"))
        after = stored(marked.select("kind", "norm", (F.col("attempt") + lost.cast("int")).alias("attempt"), lost.alias("lost")), "pii-drawn")
        now = after.drop("lost")
        if after.where("lost").isEmpty():
            return now.where("attempt > 0").select(unit_name(F.struct("kind", "norm")).alias("unit"), "attempt")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", n_chars: str = "n_chars", found: str | None = None) -> DataFrame:
    """Replace the entities of ``text``; ``n_chars``, where there is such a column, is counted anew.

    ``found`` names a column to add: the types of the replaced entities, in order. ``key`` is the
    secret that the replacements depend on.
    """
    entity_rows = found_entities(docs, text)
    anew = redrawn(entity_rows, key)
    columns = docs.columns
    # Texts that hold a unit drawn anew, whatever their number: Spark sends them to the documents if they are few.
    held = entity_rows.select("__pii_key", F.explode(units(F.col("entity"))).alias("u")).distinct()
    held = held.select("__pii_key", unit_name(F.col("u")).alias("unit")).join(anew, "unit")
    maps = held.groupBy("__pii_key").agg(F.map_from_entries(F.collect_list(F.struct("unit", "attempt"))).alias("__pii_map"))
    rows = docs.withColumn("__pii_key", digest_of(F.col(text))).join(stored(maps, "pii-maps"), "__pii_key", "left")
    attempts = F.coalesce("__pii_map", F.create_map().cast("map<string,int>"))

    def replaced(found_here: Column) -> Column:
        new = F.transform(found_here, lambda e: surrogate(key, e, attempts))
        pairs = F.arrays_zip(F.split(F.col(text), ENTITY, -1).alias("p"), new.alias("s"))
        joined = F.array_join(F.transform(pairs, lambda x: F.concat(x["p"], F.coalesce(x["s"], F.lit("")))), "")
        kinds = F.transform(found_here, kind_of)
        return F.when(F.size(found_here) > 0, F.struct(joined.alias("text"), kinds.alias("kinds")))

    hinted = F.when(F.col(text).rlike(HINT), let(entities(F.col(text)), replaced))
    made = rows.withColumn("__pii", hinted).withColumn("__pii_text", F.coalesce("__pii.text", F.col(text)))
    changed = {text: F.col("__pii_text")}
    if n_chars in columns:
        count = F.length("__pii_text").cast(docs.schema[n_chars].dataType)
        changed[n_chars] = F.when(F.col("__pii_text") != F.col(text), count).otherwise(F.col(n_chars))
    out = [changed.get(c, F.col(c)).alias(c) for c in columns if c != found]
    if found:
        out.append(F.coalesce("__pii.kinds", F.array().cast("array<string>")).alias(found))
    return made.select(*out)
