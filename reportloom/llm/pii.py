"""PII surrogates, in DataFrame functions alone.

Detected entities (e-mail addresses, phone, card, social security and bank account numbers, IPv4 and IPv6 addresses, titled
names and, in the same text, later mentions of their family names, alone or after given names and initials) are replaced by keyed surrogates of their own type and format. An entity's normal form (digits of a number, lower case of
an address) is what is replaced, and the surrogate is put back in the format of each mention, so mentions of one entity
stay mentions of one surrogate. Numbers and addresses go through a keyed Feistel network that shifts each character within
its own alphabet (digits, or letters of one script and case), with SHA-256 as its round function: on one format that is a
bijection. A card keeps its first digit, a bank account its country, and both whether their check digits are right; an
e-mail address keeps its top domain. Names are put together from syllables of the name's script and an ending of the
title's gender; a later tweak has a syllable more. Of a name's words (with apostrophes or inner capitals; a hyphen parts two)
the first of several is a given name, the others are family names, each an entity of its own; initials move to another
letter by the key, titles and particles (van, de) stay: so a full name and the later family name alone share the family name's surrogate, and so
do all who bear it (in Cyrillic and Greek script, where its form tells the gender, all of one gender).

The key is the caller's; ``key_of`` takes it from ``spark.reportloom.pii.key`` or the environment's REPORTLOOM_PII_KEY, and
draws a new one for the run where neither is set. Plans (so event logs too) hold it.

Collision checks: over all distinct entities, no two share a surrogate, and no surrogate is an entity of the corpus. Losers
are tried again with the next tweak, ``ROUNDS`` times. Where a format is so full that one is still without, all entities
of that type and format take one further tweak, under which surrogates are a bijection of entities: distinct for certain,
though one may be another entity's own form. So the checks end on every table.

Plan. A scan for the distinct entities (combined per task, so a hot entity is a row a task); one grouping of them by
surrogate, then rounds for the losers alone, which meet the others in joins that a small side lets Spark broadcast; a
second scan replaces in the row. Entities whose tweak isn't the first are exceptions, joined as one small map a text (by
its hash: copies of a text share a row, and a shared hash does no harm, as an entity has one surrogate everywhere).

Defined results: a null text stays null, an empty one empty; a text without entities is returned as it is; equal rows
have equal results, null and repeated ids are rows like others; what overlaps two types is one entity of the first that
matches; an empty table gives none.
"""

from __future__ import annotations

import os
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, written

#: Rounds of collision checks, each with a tweak of its own; the last tweak is for full formats.
ROUNDS = 12

#: By gender; those under x tell none.
TITLES = {
    "m": ["Mr", "Sir", "Lord", "Herr", "Señor", "Sr", "Don", "Monsieur", "Signor", "Dott", "г-н", "Κύριος", "κος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Señora", "Sra", "Doña", "Dra", "Madame", "Mme", "Mlle", "Signora", "г-жа", "Κυρία", "κα"],
    "x": ["Dr", "Doctor", "Doktor", "Prof", "Professor", "Ing", "Mx"],
}
#: What may stand between the words of a name and isn't one of them.
PARTICLES = "van von de der den del della di da dos du la le ter zu zur bin al".split()
#: By script (Latin, Cyrillic, Greek): what begins a syllable, what ends it, and endings of given and family names.
ONSETS = ["b d f g h j k l m n p r s t v w".split(), "б в г д ж з к л м н п р с т ф ш".split(), "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ ψ".split()]
VOWELS = ["a e i o u".split(), "а е и о у".split(), "α ε η ι ο".split()]
ENDINGS = {
    "given m": ["n r s l rt nd ck to".split(), "н р с й т мир слав лан".split(), "νος ρης λος τας κης σος μος θος".split()],
    "given f": ["na ra la sa ta nia lia rina".split(), "на ра ла ша та ния лия рина".split(), "να ρα λα τα κη σια μια θεα".split()],
    "family m": ["ner sen ton well berg mann son ley".split(), "нов ков лев рин тин дов шев ский".split(), "δης κος πουλος της ρας νης λης τος".split()],
    "family f": ["ner sen ton well berg mann son ley".split(), "нова кова лева рина тина дова шева ская".split(), "δου κου πουλου του ρα νη λη τη".split()],
}
#: Letters and digits of one script and case; a character moves within its own.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]

_TITLE = "|".join(t for g in TITLES.values() for t in g)
#: Letters with inner capitals, apostrophes (not those of a possessive) and hyphens.
_PART = r"\p{Lu}\p{L}*+(?:['’](?!s(?!\p{L}))\p{L}++)*+"
_WORD = rf"(?:(?:{'|'.join(PARTICLES)}) |\p{{Lu}}\. ?)*{_PART}(?:-{_PART})*+"
_INITIALS = r"^(?:(?:\p{Lu}\.)+|\p{Lu})$"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?:\(0[0-9]{1,4}\) ?|0[0-9]{2,3}[ /-])[0-9]{3,4}[ -]?[0-9]{2,4}(?![ -]?[0-9]))(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9-])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "ip": rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9]|\.[0-9])",
    "ipv6": rf"(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{{2,4}}(?:(?::{_HEX}){{7}}|(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![A-Za-z0-9:])",
    "name": rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? )+{_WORD}(?: {_WORD}){{0,3}}(?!\p{{L}})",
}
#: All of them; inside a word it fails at once.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value found once: a one-element array carries it."""
    return F.transform(F.array(value), body)[0]


def kind_of(mention: Column) -> Column:
    digits = F.length(F.regexp_replace(mention, "[^0-9]", ""))
    return (
        F.when(F.contains(mention, F.lit("@")), "email")
        .when(mention.rlike("^[0-9A-Fa-f]{2,4}:"), "ipv6")
        .when(mention.rlike(r"^\p{L}{2}[0-9]{2}"), "iban")
        .when(mention.rlike(r"^\p{L}"), "name")
        .when(mention.rlike(r"^[+(]"), "phone")
        .when(mention.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
        .when(mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(digits >= 13, "card")
        .otherwise("phone")
    )


def normal(mention: Column, kind: Column) -> Column:
    """What all mentions of one entity share."""
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "ip", mention)
        .when(kind == "ipv6", _expanded(mention))
        .otherwise(F.regexp_replace(mention, "[^0-9]", ""))
    )


def _expanded(address: Column) -> Column:
    """All hex digits of an IPv6 address, four a group."""
    halves = F.transform(F.split(F.lower(address), "::"), lambda h: F.filter(F.split(h, ":"), lambda g: g != ""))
    left, right = halves[0], F.coalesce(F.get(halves, F.lit(1)), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")


def parts(mention: Column, kind: Column, own: Column | None = None) -> Column:
    """The pieces of a mention as (kind, key, sep, caps), ``sep`` being what stands before a piece. All mentions but names are
    one piece, an entity. A name has its titles and particles (kind literal) and initials, a given name where there are two
    words or more, and family names; a hyphen parts two. Keys of names are a gender mark (x where the word's form doesn't
    depend on it, or the title tells none), then the word in lower case with a capital. ``own`` are the pieces of the text's
    titled names; a name without a title takes its keys from them."""
    piece = lambda kind, key, sep="", caps=False: F.struct(
        *(v.alias(n) if isinstance(v, Column) else F.lit(v).alias(n) for n, v in (("kind", kind), ("key", key), ("sep", sep), ("caps", caps)))
    )
    head = F.regexp_extract(mention, rf"^((?:(?:{_TITLE})\.? )*)", 1)
    words = F.split(F.substring(mention, F.length(head) + 1, F.length(mention)), " ")
    has = lambda gender: head.rlike(rf"(?:^| )(?:{'|'.join(TITLES[gender])})\.? ")
    foreign = lambda w: w.rlike(r"\p{IsCyrillic}|\p{IsGreek}")
    last = F.element_at(words, -1)
    formed = F.when(foreign(last), F.when(last.rlike("(?:а|я|А|Я|ου|ΟΥ)$"), "f ").otherwise("m ")).otherwise("x ")
    gender = F.when(has("f"), "f ").when(has("m"), "m ").otherwise(formed)
    plain = lambda w: w.rlike(r"^\p{Lu}") & ~w.rlike(_INITIALS)

    def named(x: Column) -> Column:
        full = F.transform(x["words"], plain)
        first = F.when(F.size(F.filter(full, lambda b: b)) > 1, F.array_position(full, F.lit(True))).otherwise(0)

        def pieces(word: Column, i: Column) -> Column:
            role = F.when(word.rlike(_INITIALS), "initial").when(~plain(word), "literal").when(first == i + 1, "given").otherwise("family")

            def entity(w: Column, j: Column) -> Column:
                sep = F.when(j > 0, "-").when(i > 0, " ").otherwise("")
                low = F.initcap(F.lower(w))
                key = F.concat(F.when((role == "given") | foreign(w), x["gender"]).otherwise("x "), low)
                if own is not None:
                    seen = F.filter(own, lambda o: (o["kind"] == role) & (F.substring(o["key"], F.lit(3), F.length(o["key"])) == low))
                    key = F.when(x["head"] == "", F.coalesce(F.get(seen, F.lit(0))["key"], key)).otherwise(key)
                return piece(role, F.when(role.isin("given", "family"), key).otherwise(w), sep, (F.length(w) > 1) & (w == F.upper(w)))

            return F.transform(F.when(role.isin("given", "family"), F.split(word, "-")).otherwise(F.array(word)), entity)

        return F.concat(F.array(piece("literal", x["head"])), F.flatten(F.transform(x["words"], pieces)))

    return F.when(kind == "name", _let(F.struct(head.alias("head"), words.alias("words"), gender.alias("gender")), named)).otherwise(F.array(piece(kind, normal(mention, kind))))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digest(secret: str, *parts: Column | int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), *(F.lit(p).cast("string") if isinstance(p, int) else p.cast("string") for p in parts)), 256)


def _shift(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _turned(half: Column, digest: Column, alphabets: tuple[str, ...] = tuple(ALPHABETS)) -> Column:
    """Each character moved on within its alphabet by the digest's bytes."""

    def turn(c: Column, i: Column) -> Column:
        out = c
        for a in reversed(alphabets):
            at = F.position(c, F.lit(a))
            out = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + _shift(digest, i), F.lit(len(a))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(half), turn), "")


def permuted(text: Column, secret: str, tweak: Column, alphabets: tuple[str, ...] = tuple(ALPHABETS)) -> Column:
    """A keyed bijection on the texts of one format (characters of the same alphabets at the same places)."""
    cut = F.floor(F.length(text) / 2).cast("int")
    whole = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))

    def rounds(s: Column, k: int) -> Column:
        if k == 4:
            return F.concat(s["l"], s["r"])
        if k % 2 == 0:
            new = F.struct(_turned(s["l"], _digest(secret, tweak, k, s["r"]), alphabets).alias("l"), s["r"].alias("r"))
        else:
            new = F.struct(s["l"].alias("l"), _turned(s["r"], _digest(secret, tweak, k, s["l"]), alphabets).alias("r"))
        return _let(new, lambda x: rounds(x, k + 1))

    return _let(whole, lambda s: rounds(s, 0))


def _luhn(payload: Column) -> Column:
    """The check digit of a row of digits."""
    digits = F.reverse(F.transform(_chars(payload), lambda c: c.cast("int")))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0), lambda s, d: s + d)
    return F.pmod(10 - total % 10, F.lit(10)).cast("int")


def _card(key: Column, secret: str, tweak: Column) -> Column:
    n = F.length(key)
    payload = F.substring(key, F.lit(1), n - 1)
    off = F.pmod(F.substring(key, n, F.lit(1)).cast("int") - _luhn(payload), F.lit(10))  # 0 for a valid card
    new = F.concat(F.substring(key, F.lit(1), F.lit(1)), permuted(F.substring(key, F.lit(2), n - 2), secret, tweak))
    return _let(new, lambda p: F.concat(p, F.pmod(_luhn(p) + off, F.lit(10)).cast("string")))


def _ip(key: Column, secret: str, tweak: Column) -> Column:
    parts = F.transform(F.split(key, r"\."), lambda x: x.cast("int"))
    start = F.struct(F.slice(parts, 1, 2).alias("l"), F.slice(parts, 3, 2).alias("r"))
    moved = lambda half, digest: F.transform(half, lambda x, i: F.pmod(x + _shift(digest, i), F.lit(256)))

    def rounds(s: Column, k: int) -> Column:
        if k == 4:
            return F.array_join(F.transform(F.concat(s["l"], s["r"]), lambda x: x.cast("string")), ".")
        text = lambda half: F.array_join(F.transform(half, lambda x: x.cast("string")), ".")
        if k % 2 == 0:
            new = F.struct(moved(s["l"], _digest(secret, tweak, k, text(s["r"]))).alias("l"), s["r"].alias("r"))
        else:
            new = F.struct(s["l"].alias("l"), moved(s["r"], _digest(secret, tweak, k, text(s["l"]))).alias("r"))
        return _let(new, lambda x: rounds(x, k + 1))

    return _let(start, lambda s: rounds(s, 0))


def _iban(key: Column, secret: str, tweak: Column) -> Column:
    """Country, check digits and account; right digits stay right, and each wrong pair becomes a wrong pair of its own."""
    country, given, account = F.substring(key, 1, 2), F.substring(key, 3, 2).cast("int"), F.substring(key, F.lit(5), F.length(key))

    def right(account: Column) -> Column:
        value = lambda c: F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
        digits = F.transform(_chars(F.concat(account, country, F.lit("00"))), value)
        return 98 - F.aggregate(digits, F.lit(0), lambda s, v: (s * F.when(v < 10, 10).otherwise(100) + v) % 97)

    def check(pair: Column) -> Column:
        wrong = given - F.when(given > pair["a"], 1).otherwise(0)
        return F.when(given == pair["a"], pair["b"]).otherwise(wrong + F.when(wrong >= pair["b"], 1).otherwise(0))

    def put(new: Column) -> Column:
        return _let(F.struct(right(account).alias("a"), right(new).alias("b")), lambda pair: F.concat(country, F.lpad(check(pair).cast("string"), 2, "0"), new))

    return _let(permuted(account, secret, tweak), put)


def _name(key: Column, kind: Column, secret: str, tweak: Column) -> Column:
    """Gender mark and a given or family name: tweak + 2 syllables and an ending; with the last tweak a syllable stands for
    each letter of the permuted word, which is a bijection."""
    bare, gender = F.substring(key, F.lit(3), F.length(key)), F.substring(key, 1, 1)
    script = F.when(bare.rlike(r"\p{IsCyrillic}"), 1).when(bare.rlike(r"\p{IsGreek}"), 2).otherwise(0)
    lists = lambda tables: F.array(*(F.array(*map(F.lit, names)) for names in tables))
    pick = lambda names, n: F.get(names, F.pmod(n, F.size(names)).cast("int"))

    def syllable(n: Column) -> Column:
        return F.concat(pick(F.get(lists(ONSETS), script), n), pick(F.get(lists(VOWELS), script), F.floor(n / 16)))

    def made(digest: Column) -> Column:
        number = lambda j: F.conv(F.substring(digest, j * 4 + 1, F.lit(4)), 16, 10).cast("int")
        short = F.transform(F.sequence(F.lit(0), tweak + 1), lambda j: syllable(number(j)))
        # 80 syllables: two for each letter tell all letters apart
        letters = F.transform(_chars(permuted(bare, secret, tweak)), lambda c: F.concat(syllable(F.ascii(c) % 80), syllable(F.floor(F.ascii(c) / 80))))
        which = F.concat(kind, F.when(gender == "f", " f").otherwise(" m"))
        tail = F.get(F.element_at(F.create_map(*(x for name, tables in ENDINGS.items() for x in (F.lit(name), lists(tables)))), which), script)
        whole = F.array_join(F.when(tweak < ROUNDS, short).otherwise(letters), "")
        return F.concat(gender, F.lit(" "), F.initcap(F.concat(whole, F.when(tweak < ROUNDS, pick(tail, number(F.lit(15)))).otherwise(F.lit("")))))

    return _let(_digest(secret, tweak, kind, F.lower(bare)), made)


def surrogate(key: Column, kind: Column, secret: str, tweak: Column) -> Column:
    """The normal form of an entity's surrogate."""
    kept = F.when(kind == "ssn", 1).otherwise(2)
    number = F.concat(F.substring(key, F.lit(1), kept), permuted(F.substring(key, kept + 1, F.length(key)), secret, tweak))
    top = F.regexp_extract(key, r"(\.[^.]+)$", 1)
    mail = F.concat(permuted(F.substring(key, F.lit(1), F.length(key) - F.length(top)), secret, tweak), top)
    made = {"email": mail, "card": _card(key, secret, tweak), "iban": _iban(key, secret, tweak), "ip": _ip(key, secret, tweak), "ipv6": permuted(key, secret, tweak, ("0123456789abcdef",))}
    out = F.when(kind.isin("given", "family"), _name(key, kind, secret, tweak))
    for name, value in made.items():
        out = out.when(kind == name, value)
    return out.otherwise(number)


def _initials(key: Column, secret: str) -> Column:
    """Each initial moved on to another letter of its alphabet, all by one distance; letters of no alphabet become Latin ones."""

    def moved(c: Column) -> Column:
        out = F.when(c.rlike(r"\p{Lu}"), F.substring(F.lit(ALPHABETS[2]), F.pmod(_shift(_digest(secret, F.lit("initial"), c), F.lit(0)), F.lit(26)) + 1, F.lit(1))).otherwise(c)
        for a in ALPHABETS[2::2]:
            by = 1 + F.pmod(_shift(_digest(secret, F.lit("initial")), F.lit(1)), F.lit(len(a) - 1))
            at = F.position(c, F.lit(a))
            out = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(key), moved), "")


def shape(key: Column, kind: Column) -> Column:
    """The format on which a type's surrogates are a bijection."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(key, "[0-9]", "0"), r"\p{Ll}", "a"), r"\p{Lu}", "A")
    return F.when(kind.isin("ip", "given", "family"), F.lit("")).otherwise(plain)


def rendered(mention: Column, kind: Column, made: Column) -> Column:
    """A normal form (of a name all its pieces) in the format of a mention; IPv6 addresses are written out."""
    place = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^A-Z0-9]", ""))
    number = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c.rlike("[A-Z0-9]"), F.substring(made, place(i), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c == F.lower(c), F.substring(made, i + 1, F.lit(1))).otherwise(F.upper(F.substring(made, i + 1, F.lit(1))))), "")
    groups = F.regexp_replace(F.regexp_replace(made, "(.{4})(?=.)", "$1:"), "(?<![0-9a-f])0{1,3}(?=[0-9a-f])", "")
    address = F.when(mention == F.lower(mention), groups).otherwise(F.upper(groups))
    return F.when(kind == "email", cased).when(kind == "ipv6", address).when(kind.isin("ip", "name"), made).otherwise(number)


def with_mentions(df: DataFrame, text: str) -> DataFrame:
    """Adds ``own`` (the name pieces of the text's titled names), ``any`` (the pattern of its mentions: the general one, and
    the family names found, alone or after given names and initials) and ``m``, all mentions in order. A text with neither a
    digit nor an at sign nor a titled name has none."""
    titled = F.regexp_extract_all(F.col(text), F.lit(PATTERNS["name"]), F.lit(0))
    pieces = F.flatten(F.transform(titled, lambda n: parts(n, F.lit("name"))))
    names = F.transform(titled, lambda n: F.split(F.regexp_replace(n, rf"^(?:(?:{_TITLE})\.? )+", ""), "[ -]"))
    df = df.withColumn("own", F.array_distinct(F.filter(pieces, lambda x: x["kind"].isin("given", "family"))))
    # the words as written, and in capitals: a family name's key tells which of them it is
    df = df.withColumn("w", F.array_distinct(F.flatten(names)))

    def written_as(role: str) -> Column:
        keys = F.transform(F.filter("own", lambda o: o["kind"] == role), lambda o: F.substring(o["key"], F.lit(3), F.length(o["key"])))
        words = F.filter("w", lambda w: F.array_contains(keys, F.initcap(F.lower(w))) & (F.length(w) > 1))
        return F.array_join(F.array_distinct(F.concat(words, F.transform(words, F.upper))), "|")

    given, family = written_as("given"), written_as("family")
    bare = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:(?:\p{Lu}\."), F.when(given != "", F.concat(F.lit("|"), given)).otherwise(""), F.lit(") )*(?:"), family, F.lit(r")(?![\p{L}\p{N}])"))
    df = df.withColumn("any", F.when(family != "", F.concat(F.lit(ANY[:-1] + "|"), bare, F.lit(")"))).otherwise(F.lit(ANY))).drop("w")
    found = F.regexp_extract_all(F.col(text), F.col("any"), F.lit(0))
    return df.withColumn("m", F.when(F.col(text).rlike("[0-9@]") | (F.size("own") > 0), found).otherwise(F.array().cast("array<string>")))


def entities_of(own: Column, mentions: Column) -> Column:
    """Distinct (kind, key) of a text's mentions."""
    found = F.flatten(F.transform(mentions, lambda m: _let(kind_of(m), lambda kind: parts(m, kind, own))))
    return F.array_distinct(F.transform(F.filter(found, lambda x: ~x["kind"].isin("literal", "initial")), lambda x: F.struct(x["kind"].alias("kind"), x["key"].alias("key"))))


def entities(docs: DataFrame, text: str) -> DataFrame:
    """Distinct (kind, key) of all texts."""
    found = with_mentions(docs.select(F.col(text).alias("t")), "t")
    # inline_outer: for inline the optimizer would add a filter that finds the mentions again
    return found.select(F.inline_outer(entities_of(F.col("own"), F.col("m")))).filter("kind is not null").distinct()


def key_of(spark: SparkSession) -> str:
    """The session's or environment's key, or a new one for this run."""
    return spark.conf.get("spark.reportloom.pii.key", None) or os.environ.get("REPORTLOOM_PII_KEY") or secrets.token_hex(32)


def dictionary(found: DataFrame, secret: str, rounds: int = ROUNDS, make=surrogate) -> DataFrame:
    """(kind, key, tweak, made) of every entity, after the collision checks."""
    made = lambda df, tweak: df.select("kind", "key", F.lit(tweak).alias("tweak"), make(F.col("key"), F.col("kind"), secret, F.lit(tweak)).alias("made"))
    known = written(found, "entities")
    own = known.select("kind", F.col("key").alias("made"))
    settled: list[DataFrame] = []
    tried = known
    for tweak in range(rounds):
        new = written(made(tried, tweak), "surrogates")
        # of entities that share a surrogate the first keeps it; none may have another's, or an entity's own form
        winner = new.groupBy("kind", "made").agg(F.min("key").alias("first"))
        names = new.select("kind", "made")
        taken = reduce(DataFrame.unionByName, (x.select("kind", "made").join(names.distinct() if tweak == 0 else names, ["kind", "made"]) for x in [own, *settled])).distinct().withColumn("taken", F.lit(True))
        judged = new.join(winner, ["kind", "made"]).join(taken, ["kind", "made"], "left")
        judged = written(judged.select("kind", "key", "tweak", "made", (F.col("taken").isNotNull() | (F.col("first") != F.col("key"))).alias("lost")), "judged")
        discard(new)
        settled.append(judged.filter("not lost").drop("lost"))
        tried = judged.filter("lost").select("kind", "key")
        if tried.isEmpty():
            return written(reduce(DataFrame.unionByName, settled), "dictionary")
    form = shape(F.col("key"), F.col("kind")).alias("shape")
    full = written(tried.select("kind", form).distinct(), "full")
    rest = reduce(DataFrame.unionByName, settled).withColumn("shape", form).join(full, ["kind", "shape"], "left_anti").drop("shape")
    last = made(known.withColumn("shape", form).join(full, ["kind", "shape"], "left_semi"), rounds)
    return written(rest.select("kind", "key", "tweak", "made").unionByName(last), "dictionary")


def pseudonymize(docs: DataFrame, secret: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_<kind>...) of every row: the text with surrogates, and how many mentions of each kind it has."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    odd = dictionary(entities(base, "t"), secret).filter("tweak > 0")
    named = lambda kind, key: F.concat(kind, F.lit(":"), key)
    x = with_mentions(base.withColumn("s", F.coalesce("t", F.lit(""))), "s")
    if odd.isEmpty():
        x = x.withColumn("odd", F.lit(None).cast("map<string,string>"))
    else:
        mine = x.select(F.xxhash64("t").alias("h"), F.inline_outer(entities_of(F.col("own"), F.col("m")))).filter("kind is not null").join(odd, ["kind", "key"])
        maps = mine.select("h", named(F.col("kind"), F.col("key")).alias("k"), "made").distinct().groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("k", "made"))).alias("odd"))
        x = x.withColumn("h", F.xxhash64("t")).join(written(maps, "maps"), "h", "left").drop("h")
    x = x.withColumn("g", F.when(F.size("m") > 0, F.split("t", F.col("any"), -1))).withColumn("k", F.transform("m", kind_of))

    def put(m: Column, i: Column) -> Column:
        kind = F.col("k")[i]
        made = lambda x: F.coalesce(F.try_element_at(F.col("odd"), named(x["kind"], x["key"])), surrogate(x["key"], x["kind"], secret, F.lit(0)))

        def word(x: Column) -> Column:
            value = F.when(x["kind"] == "literal", x["key"]).when(x["kind"] == "initial", _initials(x["key"], secret)).otherwise(_let(made(x), lambda v: F.when(kind == "name", F.substring(v, F.lit(3), F.length(v))).otherwise(v)))
            return F.concat(x["sep"], F.when(x["caps"] & x["kind"].isin("given", "family"), F.upper(value)).otherwise(value))

        return _let(F.array_join(F.transform(parts(m, kind, F.col("own")), word), ""), lambda v: rendered(m, kind, v))

    new = F.transform("m", put)
    whole = F.concat(F.array_join(F.zip_with(F.slice("g", F.lit(1), F.size("m")), new, lambda g, r: F.concat(g, r)), ""), F.element_at("g", -1))
    count = lambda kind: F.size(F.filter("k", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return x.select("doc_id", F.when(F.size("m") == 0, F.col("t")).otherwise(whole).alias("text"), *map(count, PATTERNS))
