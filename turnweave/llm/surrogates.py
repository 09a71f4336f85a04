"""Personal data replaced by surrogates, with DataFrame functions only.

Detected entities receive keyed replacements of the same kind: names keep gender, script and case, numbers keep their
grouping, addresses their parts. One entity has one replacement everywhere, so texts still refer to the same people and
accounts; two entities never share one, and no replacement equals an entity of the corpus. Both are checked on the table of
distinct entities, and entities in conflict draw again. The table grows with the corpus and stays distributed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnweave.llm.tables import kept, named
from turnweave.operators.ordering import ranked

# Draws after which the clashes of kinds with a fixed number of forms are numbered instead.
DRAWS = 12
FIXED = ("phone", "card", "national_id", "address")
CHUNK = 65_536  # numbers that a row is split into at once

# Titles by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")

# Titles of a degree, which tell no gender and may follow another title.
DEGREES = ("Dr", "Prof", "Professor", "Доктор", "Профессор")

# Titles that are no other word when written small.
SMALL = ("Professor", "Доктор", "Профессор", "Mrs", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Mr", "Herr", "Monsieur", "Señor", "Господин")

# Letters by script for replaced letters, and syllables and endings for drawn names.
LOWER, UPPER, HEX, UPPER_HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF"
LATIN, GREEK, CYRILLIC = "àáâãäåçèéêëìíîïñòóôõöùúûüý", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшэюя"
# Code points from which the letters and digits of further scripts are drawn, (test, first, last, step).
SCRIPTS = [
    (r"\p{IsHan}", 0x4E00, 0x9FA5, 83), (r"\p{IsHiragana}", 0x3042, 0x3093, 1), (r"\p{IsKatakana}", 0x30A2, 0x30F3, 1),
    (r"\p{IsHangul}", 0xAC00, 0xD7A3, 53), (r"\p{IsArabic}(?<=\p{L})", 0x0627, 0x064A, 1), (r"\p{IsHebrew}(?<=\p{L})", 0x05D0, 0x05EA, 1),
    (r"\p{IsDevanagari}(?<=\p{L})", 0x0905, 0x0939, 1), (r"\p{IsThai}(?<=\p{L})", 0x0E01, 0x0E30, 1),
    (r"\p{IsArmenian}(?<=\p{L})", 0x0561, 0x0586, 1), (r"\p{IsGeorgian}(?<=\p{L})", 0x10D0, 0x10F0, 1),
    (r"[\u0660-\u0669]", 0x0660, 0x0669, 1), (r"[\u06F0-\u06F9]", 0x06F0, 0x06F9, 1), (r"[\u0966-\u096F]", 0x0966, 0x096F, 1), (r"[\uFF10-\uFF19]", 0xFF10, 0xFF19, 1),
]
FURTHER = [
    (test, "".join(c for c in map(chr, range(first, last + 1, step)) if unicodedata.category(c) in ("Lo", "Ll", "Nd")))
    for test, first, last, step in SCRIPTS
]
SYMBOLS = "!#$%&()*+,-./;<>?@[]^_{|}~"
# A secret of these characters only is a mask or a ruler and hides nothing, so it is no entity.
_MASK = r"[*•●∙·…._#~+\-–—,;!?()\[\]{}<>|/]"
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "ka", "ke", "la", "le", "li", "ma", "me", "mi", "na", "ne", "no", "ra", "re", "ri", "ro", "sa", "se", "so", "ta", "te", "ti", "va", "vi"),
    "cyrillic": ("ба", "ве", "да", "ди", "жа", "за", "ка", "ке", "ла", "ле", "ма", "ми", "на", "не", "ра", "ри", "са", "ти", "та", "фе"),
}
ENDINGS = {
    ("latin", "female"): ("na", "lia", "ra", "ssa"),
    ("latin", "male"): ("n", "rt", "s", "ld"),
    ("latin", "family"): ("ner", "son", "mann", "ley"),
    ("latin", "given"): ("en", "i", "o", "is"),
    ("cyrillic", "female"): ("на", "ля", "ра", "са"),
    ("cyrillic", "male"): ("н", "р", "с", "л"),
    ("cyrillic", "family"): ("ко", "дзе", "ян", "чук"),
    ("cyrillic", "given"): ("ей", "и", "о", "ис"),
}

_BYTE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# A name: apostrophes behind its first letter and hyphens before a capital belong to it, a possessive does not.
_CAPITAL = r"\p{Lu}(?:['’]\p{Lu})?\p{L}++(?:[-‐]\p{Lu}\p{L}++)*+"
_GROUP = r"[0-9A-Fa-f]{1,4}"


def _titles(titles: tuple[str, ...]) -> str:
    words = [f"[{t[0]}{t[0].lower()}]{t[1:]}" if t in SMALL else t for t in titles]
    return rf"(?:{'|'.join(words)})\.? "


# (kind, pattern): a part of a text is what the first fitting pattern says; all but secrets begin where no letter or digit
# stands before. Names and secrets include what introduces them; key words of secrets are read without case, also inside
# longer names. Fixed values.
PATTERNS = [
    ("secret", rf"(?i:password|passwd|pwd|secret|token|api[_-]?key)(?:[_.-]?(?i:key|value|hash|string)(?![\p{{L}}\p{{N}}])|[_.-][\p{{L}}\p{{N}}_.-]{{0,40}}+|\d{{1,4}}+)?[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?(?!{_MASK}++(?:[\s\"'=:]|$))[^\s\"'=:]{{6,}}+"),
    ("login", r"(?<=://)[^\s/@:]{1,64}:[^\s/@]{1,128}(?=@)"),
    ("email", r"[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.){1,8}\p{L}{2,24}"),
    ("access_key", r"(?:AKIA[0-9A-Z]{16}|[sp]k-[A-Za-z0-9]{20,}+|gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![\p{L}\p{N}])"),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("network", rf"(?=[0-9A-Fa-f:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}|(?:{_GROUP}:){{2,7}}:)(?![\p{{L}}\p{{N}}:])"),
    ("card", r"(?<![.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![\d-])|(?<![.-])3[47]\d\d[ -]?\d{6}[ -]?\d{5}(?![\d-])|(?<![.-])3(?:0[0-5]|[68]\d)\d[ -]?\d{6}[ -]?\d{4}(?![\d-])"),
    ("phone", r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+(?=(?:[ .-]?[()]?\d){8,15}+(?!\d))\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}+(?!\d)|(?<![.-])(?<!\d )\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d|[.-]\d)|(?<![.,/-])(?<!\d )0\d{2,4}[ /-]\d{5,8}(?!\d|[.,/-]\d)"),
    ("national_id", r"(?<![.-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("address", rf"(?<!\.)(?:{_BYTE}\.){{3}}{_BYTE}(?![\p{{L}}\d]|\.\d)"),
    ("person", rf"{_titles(FEMALE + MALE + DEGREES)}(?:{_titles(DEGREES)}){{0,2}}{_CAPITAL}(?: {_CAPITAL})?"),
]
PATTERN = rf"{PATTERNS[0][1]}|(?<![\p{{L}}\p{{N}}])(?:{'|'.join(p for _, p in PATTERNS[1:])})"
# The two parts of a person: titles, and one or two names.
PERSON = rf"^((?:{_titles(FEMALE + MALE + DEGREES)})+)({_CAPITAL})(?: ({_CAPITAL}))?$"


def may_hold(text: Column) -> Column:
    """A cheap test that every text with an entity passes: a digit, an at sign, a title or a key word."""
    titles = [*FEMALE, *MALE, *DEGREES, *[f"{t.lower()}{end}" for t in SMALL for end in (" ", ". ")]]
    words = ("passw", "pwd", "secret", "token", "api")
    issued = ("AKIA", "sk-", "pk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox")
    tests = [text.contains(w) for w in (*titles, *issued)] + [F.lower(text).contains(w) for w in words]
    return reduce(lambda a, b: a | b, tests, text.rlike("[0-9@]"))


def found_in(text: Column) -> Column:
    """Entities of a text in order: (match, lead, kind, mention). The lead introduces the mention and stays.

    The text is searched once; what a match is, is told from the match alone. A person gives one or two entities of one
    match. What only looks like a bank account has no kind and stays.
    """

    def entity(kind: Column, lead: Column, mention: Column) -> Column:
        return F.struct(kind.alias("kind"), lead.alias("lead"), mention.alias("mention"))

    def entities(whole: Column) -> Column:
        title = F.regexp_extract(whole, PERSON, 1)
        first, second = F.regexp_extract(whole, PERSON, 2), F.regexp_extract(whole, PERSON, 3)
        given = F.when(title.rlike(_titles(FEMALE)), "female_name").when(title.rlike(_titles(MALE)), "male_name").otherwise("given_name")
        person = F.when(
            F.length(second) > 0, F.array(entity(given, title, first), entity(F.lit("family_name"), F.lit(" "), second))
        ).otherwise(F.array(entity(F.lit("family_name"), title, first)))
        # What stands before a login tells it, which the match alone does not hold: it is what nothing else fits.
        plain = F.lit("login")
        for kind, pattern in reversed(PATTERNS[:-1]):
            if kind != "login":
                name = F.when(valid_iban(canonical(F.lit("iban"), whole)), kind) if kind == "iban" else F.lit(kind)
                plain = F.when(whole.rlike(rf"\A(?:{pattern})\z"), name).otherwise(plain)
        lead = F.when(plain == "secret", F.regexp_extract(whole, r"(?s)^(.*[=:]\s{0,3}[\"']?)", 1)).otherwise("")
        other = F.array(entity(plain, lead, F.substring(whole, F.char_length(lead) + 1, F.char_length(whole))))
        return F.when(F.length(first) > 0, person).otherwise(other)

    matches = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), entities)
    numbered = F.transform(
        matches,
        lambda found, at: F.transform(found, lambda e: F.struct((at + 1).alias("match"), e["lead"].alias("lead"), e["kind"].alias("kind"), e["mention"].alias("mention"))),
    )
    return F.flatten(numbered)


def _remainder(digits: Column) -> Column:
    """Remainder by 97 of a number written with letters as 10 to 35."""
    code = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.try_cast("int"))
    step = lambda rest, c: (rest * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda rest, c: F.when(F.length(c) == 0, rest).otherwise(step(rest, c)))


def valid_iban(value: Column) -> Column:
    """Whether an account number without blanks has the right check digits."""
    return _remainder(F.concat(F.substring(value, F.lit(5), F.char_length(value)), F.left(value, F.lit(4)))) == 1


def canonical(kind: Column, mention: Column) -> Column:
    """What stays the same over the ways in which one entity is written."""
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind.isin("card", "national_id"), digits)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind.isin("secret", "access_key", "address", "login"), mention)
        .otherwise(F.lower(mention))
    )


def _luhn(digits: Column, extra: int = 0) -> Column:
    """Checksum of a number; ``extra`` digits are still to follow."""
    size = F.char_length(digits)

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, size - at + 1, F.lit(1)).cast("int") * (1 + (at + extra + 1) % 2)
        return total + digit % 10 + F.floor(digit / 10).cast("int")

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10


def _drawn(noise: Column, at: Column, bound: int) -> Column:
    """A number below ``bound`` from the ``at``-th (from 0) four hexadecimal digits of the noise, which it repeats."""
    return F.conv(F.substring(noise, (at % 31) * 4 + 1, F.lit(4)), 16, 10).cast("int") % bound


def _letter(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), number + 1, F.lit(1))


def _bound(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of the values, which are computed once."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def _like(value: Column, noise: Column, hexadecimal: bool = True) -> Column:
    """Each letter and digit replaced by one of its script, class and case; other characters stay.

    Long hexadecimal numbers stay such, unless ``hexadecimal`` is false.

    Letters and digits of scripts without an alphabet become Latin letters and ASCII digits. In a value without any letter
    or digit the symbols themselves are drawn, so no value stays as it is in every draw.
    """
    alphabets = [
        ("[0-9]", "0123456789"), ("[a-z]", LOWER), ("[A-Z]", UPPER), (r"\p{IsGreek}(?<=\p{L})", GREEK), (r"\p{IsCyrillic}(?<=\p{L})", CYRILLIC),
        (r"\p{IsLatin}(?<=\p{L})", LATIN), *FURTHER, (r"\p{L}", LOWER), (r"\p{N}", "0123456789"),
    ]

    def one(row: Column, at: Column, char: Column) -> Column:
        drawn = lambda a: _letter(a, _drawn(row["noise"], at + F.floor(at / 31).cast("int"), len(a)))
        choices = [(char.rlike(test), drawn(a)) for test, a in alphabets]
        picked = F.when(row["hexadecimal"], drawn(HEX)).when(row["upper_hex"], drawn(UPPER_HEX)).when(row["plain"], drawn(SYMBOLS))
        return reduce(lambda c, choice: c.when(*choice), choices, picked).otherwise(char)

    def whole(row: Column) -> Column:
        places = F.sequence(F.lit(1), F.char_length(row["value"]))
        chars = F.transform(places, lambda at: F.struct(at.alias("at"), F.substring(row["value"], at, F.lit(1)).alias("char")))
        return F.array_join(F.transform(chars, lambda c: one(row, c["at"], c["char"])), "")

    small, large = (value.rlike(p) if hexadecimal else F.lit(False) for p in ("^[0-9a-f]{16,}$", "^[0-9A-F]{16,}$"))
    row = {"hexadecimal": small, "upper_hex": large, "plain": ~value.rlike(r"[\p{L}\p{N}]")}
    return F.when(F.char_length(value) > 0, _bound(whole, value=value, noise=noise, **row)).otherwise("")


def _hexadecimal(value: Column, noise: Column) -> Column:
    """Each hexadecimal digit replaced by another draw; colons stay."""
    chars = F.transform(
        F.sequence(F.lit(1), F.char_length(value)),
        lambda at: F.when(F.substring(value, at, F.lit(1)) == ":", ":").otherwise(F.substring(noise, at + 64, F.lit(1))),
    )
    return F.array_join(chars, "")


def _name(kind: str, script: str, noise: Column) -> Column:
    syllables, endings = SYLLABLES[script], ENDINGS[script, kind]
    parts = [F.element_at(F.array(*map(F.lit, syllables)), _drawn(noise, F.lit(k), len(syllables)) + 1) for k in range(2)]
    return F.concat(*parts, F.element_at(F.array(*map(F.lit, endings)), _drawn(noise, F.lit(2), len(endings)) + 1))


def _longer(script: str, noise: Column, draw: Column) -> Column:
    """Syllables before a name: one more in each draw from the third on, so names never run out."""
    syllables = F.array(*map(F.lit, SYLLABLES[script]))
    drawn = lambda k: F.element_at(syllables, _drawn(noise, k + 2, len(SYLLABLES[script])) + 1)
    return F.when(draw > 1, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(draw - 1, F.lit(1))), drawn), "")).otherwise("")


def _digits(noise: Column, first: int, count: int) -> Column:
    return F.concat(*[_drawn(noise, F.lit(first + k), 10).cast("string") for k in range(count)])


def surrogate(kind: Column, value: Column, draw: Column, key: str) -> Column:
    """The replacement of a canonical entity in a draw; cards with a right checksum get one again."""
    noise = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, draw.cast("string"), value), 512)
    issuer = F.when(kind == "access_key", F.regexp_extract(value, "^(AKIA|[sp]k-|gh[pousr]_|xox[abprs]-)", 1)).otherwise("")
    top = F.when(kind == "email", F.substring_index(value, ".", -1)).otherwise("")
    return _bound(_surrogate, kind=kind, value=value, draw=draw, noise=noise, issuer=issuer, top=top)


def _surrogate(row: Column) -> Column:
    kind, value, draw, noise, issuer, top = [row[c] for c in ("kind", "value", "draw", "noise", "issuer", "top")]
    above = lambda k: (_drawn(noise, F.lit(k), 8) + 2).cast("string")  # noqa: E731  (2 to 9)
    # Cards of 14 and 15 digits keep the two digits that tell their kind.
    issued = F.when(F.char_length(value) < 16, 2).otherwise(1)
    number = F.left(F.concat(F.left(value, issued), _digits(noise, 0, 14)), F.char_length(value) - 1)
    card = F.concat(number, ((10 - _luhn(number, 1)) % 10).cast("string"))
    octets = [(_drawn(noise, F.lit(0), 223) + 1), *[_drawn(noise, F.lit(k), 256) for k in (1, 2, 3)]]
    # What is drawn letter by letter; few letters give few values, so further draws add some before the at sign or behind.
    size = F.char_length(value) - F.char_length(issuer) - F.char_length(top)
    free = _like(F.substring(value, F.char_length(issuer) + 1, size), noise)
    more = F.translate(F.left(F.sha2(F.concat(noise, F.lit("more")), 512), F.greatest(draw - 2, F.lit(0))), "0123456789", "ghijklmnop")
    free = F.when(kind == "email", F.replace(free, F.lit("@"), F.concat(more, F.lit("@")))).otherwise(F.concat(free, more))
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    names = {
        k: F.when(cyrillic, F.concat(_longer("cyrillic", noise, draw), _name(k, "cyrillic", noise)))
        .otherwise(F.concat(_longer("latin", noise, draw), _name(k, "latin", noise)))
        for k in ("female", "male", "family", "given")
    }
    body = _like(F.substring(value, F.lit(5), F.char_length(value)), noise, hexadecimal=False)
    checked = 98 - _remainder(F.concat(body, F.left(value, F.lit(2)), F.lit("00")))
    iban = F.concat(F.left(value, F.lit(2)), F.lpad(checked.cast("string"), 2, "0"), body)
    # Short network addresses have few forms, so later draws are written in full.
    groups = F.concat_ws(":", *[F.substring(noise, 4 * k + 1, 4) for k in range(8)])
    network = F.when(draw > 2, groups).otherwise(_hexadecimal(value, noise))
    return (
        F.when(kind.isin("email", "access_key", "secret", "login"), F.concat(issuer, free, top))
        .when(kind == "iban", iban)
        .when(kind == "network", network)
        .when((kind == "phone") & F.startswith(value, F.lit("0")), F.left(F.concat(F.lit("0"), above(1), _digits(noise, 2, 8)), F.char_length(value)))
        .when(kind == "phone", F.left(F.concat(above(0), _digits(noise, 1, 2), above(3), _digits(noise, 4, 6)), F.char_length(value)))
        .when((kind == "card") & (_luhn(value) == 0), card)
        .when(kind == "card", F.concat(number, _digits(noise, 16, 1)))
        .when(kind == "address", F.concat_ws(".", *[o.cast("string") for o in octets]))
        .when(kind == "national_id", F.concat(above(0), _digits(noise, 1, 8)))
        .when(kind == "female_name", names["female"])
        .when(kind == "male_name", names["male"])
        .when(kind == "given_name", names["given"])
        .otherwise(names["family"])
    )


def _grouped(mention: Column, written: Column, counted: str) -> Column:
    """The characters of ``written`` in the places of the mention that ``counted`` matches; all between stays."""
    gaps = F.split(mention, counted, -1)
    places = F.sequence(F.lit(1), F.size(gaps) - 1)
    turns = F.transform(places, lambda k: F.concat(F.element_at(gaps, k), F.substring(written, k, F.lit(1))))
    return F.concat(F.array_join(turns, ""), F.element_at(gaps, -1))


def rendered(kind: Column, mention: Column, replacement: Column) -> Column:
    """The replacement in the writing of the mention: grouping of numbers, case of words."""
    digits = F.regexp_replace(mention, r"\D", "")
    whole = F.concat(F.left(digits, F.char_length(digits) - F.char_length(replacement)), replacement)
    return (
        F.when(kind.isin("phone", "card", "national_id"), _grouped(mention, whole, "[0-9]"))
        .when(kind == "iban", _grouped(mention, replacement, "[A-Z0-9]"))
        .when(kind.isin("secret", "access_key", "address", "login"), replacement)
        .when(kind == "network", F.when(F.upper(mention) == mention, F.upper(replacement)).otherwise(replacement))
        .otherwise(_cased(mention, replacement))
    )


def _cased(mention: Column, replacement: Column) -> Column:
    first = F.left(mention, F.lit(1))
    rest = F.substring(replacement, F.lit(2), F.char_length(replacement))
    return (
        F.when((F.upper(mention) == mention) & (F.char_length(mention) > 1), F.upper(replacement))
        .when(F.upper(first) == first, F.concat(F.upper(F.left(replacement, F.lit(1))), rest))
        .otherwise(replacement)
    )


def _again(text: Column, names: Column) -> Column:
    """Bare mentions of the names of a text, (kind, value, replacement): as they are written behind a title, in capitals and,
    for family names, small. A name right behind a title in capitals stays, as that is read as no title."""
    edge = r"(?![\p{L}\p{N}])"

    def one(body: Column, name: Column) -> Column:
        value, shown = name["value"], name["replacement"]
        initial = F.concat(F.upper(F.left(shown, F.lit(1))), F.substring(shown, F.lit(2), F.char_length(shown)))
        written = F.regexp_replace(F.initcap(F.regexp_replace(value, "['’‐-]", " $0 ")), " (['’‐-]) ", "$1")
        body = F.regexp_replace(body, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), written, F.lit(edge)), initial)
        body = F.regexp_replace(
            body, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?<!\b(?:MR|MRS|MS|MISS|HERR|FRAU|DR|PROF)\.? )"), F.upper(value), F.lit(edge)), F.upper(shown)
        )
        small = F.regexp_replace(body, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), value, F.lit(edge)), shown)
        return F.when(name["kind"] == "family_name", small).otherwise(body)

    return F.aggregate(names, text, one)


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, replacement) for distinct (kind, value): replacements are distinct, and none is a value itself."""
    now = kept(entities.withColumn("draw", F.lit(0)), "entities")
    same = Window.partitionBy("family", "replacement").orderBy("draw", "kind", "value")
    # Given names and family names are told apart by nothing in a text, so all names share one space.
    family = F.when(F.col("kind").endswith("_name"), "name").otherwise(F.col("kind")).alias("family")
    values = now.select(family, F.col("value").alias("replacement")).distinct().withColumn("taken", F.lit(True))
    drawn, settled = 0, None
    # Names, mails, keys and secrets grow with the draw, so their clashes end by themselves.
    while True:
        found = now.withColumn("replacement", surrogate(F.col("kind"), F.col("value"), F.col("draw"), key))
        ranked_rows = found.withColumn("family", family).withColumn("nth", F.row_number().over(same))
        checked = ranked_rows.join(values, ["family", "replacement"], "left")
        clash = (F.col("nth") > 1) | F.col("taken").isNotNull()
        checked = kept(checked.select("kind", "value", "draw", "replacement", clash.alias("clash")), "drawn")
        drawn += 1
        if drawn == DRAWS:
            late = checked.filter(F.col("clash") & F.col("kind").isin(*FIXED))
            settled = kept(numbered_forms(late.select("kind", "value"), checked.filter("not clash"), now, key), "numbered")
            checked = checked.filter(~(F.col("clash") & F.col("kind").isin(*FIXED)))
        if checked.filter("clash").limit(1).count() == 0:
            done = checked.select("kind", "value", "replacement")
            return done if settled is None else done.union(settled)
        now = checked.select("kind", "value", (F.col("draw") + F.col("clash").cast("int")).alias("draw"))


def _form(kind: Column, value: Column) -> tuple[Column, Column, Column]:
    """What a replacement of a fixed kind keeps of the value, the number of its free digits, and the number of its forms."""
    size = F.char_length(value)
    valid = (_luhn(value) == 0).cast("int")
    issued = F.when(size < 16, 2).otherwise(1)
    free = F.when(kind == "card", size - issued - valid).when(kind == "phone", size - 2).when(kind == "national_id", 8).otherwise(0)
    fixed = F.when(kind == "card", F.concat(F.left(value, issued), valid.cast("string"))).otherwise("")
    ten = F.rpad(F.lit("1"), free + 1, "0").cast("decimal(20,0)")
    first = F.when(kind == "phone", 64).when(kind == "national_id", 8).when(kind == "address", 223 * 256**3).otherwise(1)
    return fixed, free, (ten * first.cast("decimal(12,0)")).cast("decimal(32,0)")


def _of_form(kind: Column, fixed: Column, free: Column, number: Column) -> Column:
    """The form of a number below the number of forms."""

    def part(by: int) -> Column:
        return F.call_function("div", number, F.lit(by).cast("decimal(12,0)"))

    def digit(over: int) -> Column:
        return (part(over) % 8 + 2).cast("string")

    rest = lambda by: F.when(free > 0, F.lpad(part(by).cast("string"), free, "0")).otherwise("")
    issued = F.left(fixed, F.char_length(fixed) - 1)
    card = F.concat(issued, rest(1))
    octets = [(part(1) % 223 + 1).cast("string"), *[(part(223 * 256**k) % 256).cast("string") for k in range(3)]]
    return (
        F.when(kind == "phone", F.concat(digit(1), F.left(rest(64), F.lit(2)), digit(8), F.substring(rest(64), F.lit(3), free)))
        .when(kind == "national_id", F.concat(digit(1), rest(8)))
        .when(kind == "address", F.concat_ws(".", *octets))
        .when(F.right(fixed, F.lit(1)) == "1", F.concat(card, ((10 - _luhn(card, 1)) % 10).cast("string")))
        .otherwise(card)
    )


def numbered_forms(late: DataFrame, settled: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, replacement) for values of fixed kinds that clash in all draws, by numbers instead of draws.

    A keyed permutation of all forms of a kind lists candidates, as many as forms can be taken and one for each value. Those
    that are no replacement and no value of the corpus are dealt out in order; only where a corpus holds more than half of all
    forms, forms that are another entity's value follow. As there are no more values than forms, each gets one of its own.
    """
    fixed, free, forms = _form(F.col("kind"), F.col("value"))
    shaped = kept(late.select("kind", "value", fixed.alias("fixed"), free.alias("free"), forms.alias("forms")), "late")
    shape = ["kind", "fixed", "free", "forms"]
    known = entities.filter(F.col("kind").isin(*FIXED)).select("kind", F.col("value").alias("replacement"), F.lit(False).alias("used"))
    known = known.union(settled.filter(F.col("kind").isin(*FIXED)).select("kind", "replacement", F.lit(True)))
    known = kept(known.groupBy("kind", "replacement").agg(F.max("used").alias("used")), "known-forms")
    held = known.groupBy("kind").agg(F.count(F.lit(1)).alias("held"))
    wanted = shaped.groupBy(*shape).agg(F.count(F.lit(1)).alias("wanted")).join(held, "kind")
    most = F.least(F.col("forms"), (F.col("wanted") + F.col("held")).cast("decimal(32,0)")).cast("bigint")
    chunks = wanted.withColumn("most", most).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("most") - 1) / CHUNK))))
    last = F.least(F.col("most"), (F.col("chunk") + 1) * CHUNK) - 1
    listed = chunks.select(*shape, F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("i"))
    # The factor is a prime that divides no number of forms, so the numbers of a shape are a permutation.
    begin = F.conv(F.left(F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "fixed"), 256), F.lit(12)), 16, 10).cast("decimal(20,0)")
    number = (F.col("i").cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(12,0)") + begin) % F.col("forms")
    forms_listed = listed.withColumn("number", number.cast("decimal(32,0)"))
    forms_listed = forms_listed.withColumn("replacement", _of_form(F.col("kind"), F.col("fixed"), F.col("free"), F.col("number")))
    open_forms = forms_listed.join(known, ["kind", "replacement"], "left").filter("used is null or not used")
    order = [*shape[:3], F.col("used").isNotNull(), "i"]
    places = ranked(open_forms.select(*shape[:3], "used", "i", "replacement"), order, "place")
    askers = ranked(shaped.select(*shape[:3], "value"), [*shape[:3], "value"], "place")
    both = []
    for rows, name in ((places, "replacement"), (askers, "value")):
        first = kept(rows.groupBy(*shape[:3]).agg(F.min("place").alias("first")), "first-places")
        both.append(rows.join(first, shape[:3]).select(*shape[:3], (F.col("place") - F.col("first")).alias("nth"), name))
    return both[0].join(both[1], [*shape[:3], "nth"]).select("kind", "value", "replacement")


def replaced(docs: DataFrame, text_column: str = "text", key: str = "turnweave", count_column: str | None = None) -> DataFrame:
    """``docs`` with every entity of the text replaced; all other columns stay as they are, whatever their names.

    Null and empty texts, and texts without entities, stay unchanged. ``count_column`` adds the number of replaced
    mentions (bare mentions of a name are not counted). Rows that repeat are replaced alike. ``key`` decides the
    replacements; keep it secret. Once a name stands behind a title, it is replaced wherever that text repeats it.
    """
    (text,) = named([text_column])
    holds = F.coalesce(may_hold(text) & text.rlike(PATTERN), F.lit(False))
    count = [] if count_column is None else [F.lit(0).alias(count_column)]
    clean = docs.filter(~holds).select(*named(docs.columns), *count)
    row = F.struct(*named(docs.columns)).alias("row")
    held = kept(docs.filter(holds).select(row, text.alias("body"), F.sha2(text, 256).alias("place")), "held-texts")
    # Texts are told apart by their digest; copies of a text are looked at once. The number of tasks is that of shuffles,
    # as searching costs far more than the bytes of the texts tell.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mentions = kept(
        held.select("place", "body").repartition(tasks, "place")
        .groupBy("place")
        .agg(F.first("body").alias("body"))
        .select("place", F.posexplode(found_in(F.col("body"))).alias("nth", "found"))
        .select("place", "nth", "found.*", canonical(F.col("found.kind"), F.col("found.mention")).alias("value")),
        "mentions",
    )
    table = kept(surrogate_table(mentions.filter("kind is not null").select("kind", "value").distinct(), key), "surrogates")
    shown = F.coalesce(rendered(F.col("kind"), F.col("mention"), F.col("replacement")), F.col("mention"))
    is_name = F.col("kind").endswith("_name")
    written = mentions.join(table, ["kind", "value"], "left").select(
        "place", F.struct("nth", "match", F.concat("lead", shown).alias("shown"), F.col("kind").isNotNull().alias("changed")).alias("entity"),
        F.when(is_name, F.struct((-F.char_length("value")).alias("order"), "value", "kind", "replacement")).alias("name"),
    )
    lines = written.groupBy("place").agg(
        F.array_sort(F.collect_list("entity")).alias("shown"), F.array_sort(F.collect_set("name")).alias("names")
    )
    gaps = F.split("body", PATTERN, -1)
    # Before each match stands a gap of the text, in which names come up again without a title.
    again = F.when(F.size("names") > 0, F.transform(gaps, lambda gap: _again(gap, F.col("names")))).otherwise(gaps)

    def assembled(row: Column) -> Column:
        entities, between = row["shown"], row["gaps"]
        before = lambda e, at: F.when((at > 0) & (F.get(entities, at - 1)["match"] == e["match"]), "").otherwise(F.element_at(between, e["match"]))
        told = F.transform(entities, lambda e, at: F.concat(before(e, at), e["shown"]))
        return F.concat(F.array_join(told, ""), F.element_at(between, -1))

    joined = held.join(lines, "place").withColumn("_new", _bound(assembled, shown=F.col("shown"), gaps=again))
    count = [] if count_column is None else [F.size(F.filter("shown", lambda e: e["changed"])).alias(count_column)]
    changed = joined.select(
        *[F.col("_new").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns], *count
    )
    return clean.unionByName(changed)
