"""Surrogates for personal data, with DataFrame functions only.

Mentions are found by one pattern, in one pass. A mention names an entity (type, canonical form); every entity of the corpus gets
one keyed surrogate of its type, script and format, so mentions of one entity stay mentions of one entity, however
they are written. Rounds of collision checks keep different entities different and no surrogate is a real entity.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import bind
from .common import Scratch, join_spread

# What introduces a name, by gender.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "господин", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "г-жа", "госпожа", "κυρία"]
EITHER = ["Dr", "Prof"]
# Titles that are abbreviations; in capitals they count with a full stop only.
SHORT = ["Mr", "Mrs", "Ms", "Mme", "Sr", "Sra", "Dr", "Prof"]
# Small words inside names; they stay as they are.
PARTICLES = ["van", "von", "der", "den", "ten", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "al", "el", "bin", "ibn"]
# Names that are common words, too; alone and without a title they stay.
COMMON = """amber april art ash august autumn baker bill black bond brook brown bush case chance chase christian church clay cook
cross daisy dale dawn day dean drew earl english ernst faith field fisher ford forest frank french gay gene glen good grace grant gray
green grey guy hall harmony hazel heather heath hill holly hope hunter iris ivy jack jasmine jay jean joy june king klein knight lake lily
long love major mark marsh mason may miles miller miss moon neu noble north olive page park penny poppy price prince ray rich rob robin
rock rose ruby rusty sandy sonntag scarlet short sky small south star stein stern stone storm summer taylor temple violet wade ward wells
west white will winter wolf wood young""".split()
# Given names by script and gender; those of no gender are of use to both.
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gustav", "Henry", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olivia", "Paula"],
    ("latin", ""): ["Alex", "Chris", "Jamie", "Jules", "Kim", "Luca", "Micha", "Noor", "Quinn", "Robin", "Sam", "Toni"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис", "Иван", "Олег", "Павел", "Сергей"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"],
    ("cyrillic", ""): ["Валя", "Женя", "Саша", "Слава"],
    ("greek", "m"): ["Γιώργος", "Κώστας", "Νίκος", "Πέτρος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("greek", ""): ["Άλεξ", "Χάρις"],
}
# Further given names that tell a gender where no title does.
TELLING = {
    "m": "albert alexander andreas anthony antonio arthur benjamin charles christian christopher daniel dieter dmitri edward eric ernst francisco frank franz fred friedrich george giovanni hans harry heinrich hugo jack jacques james jan jean johann john jorge jose joseph josé juan jürgen klaus lars lewis louis luis manuel marco mark max michael miguel nicolas nikolai otto pablo patrick pedro peter philip pierre richard robert rudolf sergio simon stefan stephen thomas tobias tom victor walter werner william wolfgang алексей андрей владимир дмитрий михаил николай пётр γιάννης δημήτρης",
    "f": "alice amelia ana andrea angela angelika ann anne beatrice birgit brigitte camille carla carmen caroline catherine charlotte christina christine claudia cristina doris dorothea edith elisabeth elizabeth emily emma erika eva florence frieda gabriele gertrud hannah heidi helga hilda ida ingrid isabel jane jean jennifer jessica johanna josefa juliette karen katharina linda lisa lucia lucy luisa margaret margarita marie marta martha mary monika nancy nina patricia petra renate rosa ruth sabine sandra sara sarah sofia sophie susan susanne teresa ursula vera victoria александра екатерина наталья светлана татьяна αικατερίνη δήμητρα",
}
# Sets of characters that stand in for each other.
CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâäåèéêëìíîïòóôöùúûü", "ÀÁÂÄÅÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "çñš", "ÇÑŠ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αειουω", "βγδζθκλμνξπρστφχψ", "ΑΕΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
#: Blocks of letters: what no class above holds is replaced within its block and case.
BLOCKS = [(0xDF, 0x250), (0x370, 0x400), (0x400, 0x530), (0x531, 0x588), (0x5D0, 0x5EB), (0x621, 0x64B), (0x904, 0x93A), (0xE01, 0xE31), (0x10D0, 0x10FB), (0x3041, 0x3097), (0x30A1, 0x30FB)]
#: Blocks that are letters throughout: replaced by code point.
RANGES = [(0x4E00, 0x9FA6), (0xAC00, 0xD7A4)]
HEX = "0123456789abcdef"
# 16 letters of a script, that names grow by where no surrogate of their format is free.
MORE = {"latin": "bdfgklmnrstaeiou", "cyrillic": "бвгдклмнрстаеиоу", "greek": "βγδκλμνξρσταειοω"}


def _blocks() -> list[str]:
    done, out = set("".join(CLASSES)), []
    for first, last in BLOCKS:
        for case in (("Ll",), ("Lu", "Lt"), ("Lo",)):
            letters = "".join(c for c in map(chr, range(first, last)) if unicodedata.category(c) in case and c not in done)
            out += [letters] if len(letters) > 1 else []
    return out


ALL_CLASSES = CLASSES + _blocks()

# The groups that repeat are possessive, so no text makes the matcher recurse or retry.
_SECRET = r"(?i:p(?:assw(?:or)?d|wd)|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?"
_TITLES = sorted(MALE + FEMALE + EITHER, key=lambda t: -len(t))
_CAPITALS = [t.upper() + (r"\." if t in SHORT else r"\.?") for t in _TITLES if t != t.upper()]
_TITLE = "(?:" + "|".join([t + r"\.?" for t in _TITLES] + _CAPITALS) + r")\s{1,3}"
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’]\p{Lu}))(?:(?:-|['’](?![sS](?!\p{L})))\p{Lu}[\p{L}\p{M}]*+)*+"
_GAP = r"[ \t\x{A0}]{1,3}"
_SMALL = rf"(?:\p{{Lu}}\.{_GAP}|(?:{'|'.join(PARTICLES)}){_GAP}){{0,3}}"
_NAME = rf"(?:\p{{Lu}}{_GAP})?{_SMALL}{_WORD}(?:{_GAP}{_SMALL}{_WORD})?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_LABEL = r"[\p{L}0-9]++(?:-++[\p{L}0-9]++)*+"
_GROUP = "[0-9A-Fa-f]{1,4}"
PATTERN = "|".join([
    rf"(?<![\p{{L}}0-9._%+-])[\p{{L}}0-9._%+-]++@{_LABEL}(?:\.{_LABEL})++",
    _SECRET + r"(?=[A-Za-z+/_.-]*+\d)[A-Za-z0-9+/_.-]{8,}+",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"(?<![\p{L}\d)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\p{L}\d.+-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\p{L}\d-]|\.\d)",
    rf"(?<![\p{{L}}\d:.])(?=[A-Fa-f:]*+\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}:(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\p{{L}}\d:])",
    rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    r"(?<![\d.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d|\.\d)",
    rf"(?<!\p{{L}}){_TITLE}{_NAME}",
])
# Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: From this round of collision checks on names, secrets and e-mail addresses grow by letters of their own script, phones
#: by digits; an IPv6 address is written in full. The other formats have a fixed length and go on within it.
STRICT_ROUNDS = 8
#: Rounds after which a format of fixed length counts as full, which raises.
MOST_ROUNDS = 300


def kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^" + _SECRET), "secret")
        .when(m.startswith("AKIA"), "access_key")
        .when(m.rlike(r"^[+(]\d|^\d{3}([.-])\d{3}\1\d{4}$"), "phone")
        .when(m.rlike("^[0-9A-Fa-f]{1,4}:"), "ipv6")
        .when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "national_id")
        .when(m.rlike(r"^[\d -]+$"), "card")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .otherwise("name")
    )


def parsed(m: Column) -> Column:
    """(kind, gender, prefix, value, canonical) of a mention."""

    def of(k: Column) -> Column:
        prefix = F.when(k == "secret", F.regexp_extract(m, f"^({_SECRET})", 1)).when(k == "name", F.regexp_extract(m, f"^({_TITLE})", 1)).otherwise("")
        title = F.lower(F.regexp_replace(prefix, r"[.\s]+$", ""))
        value = F.substring(m, F.length(prefix) + 1, F.length(m))
        spaced = F.lower(F.regexp_replace(value, r"[\s\x{A0}]+", " "))
        first = F.regexp_extract(spaced, r"^(\p{L}+)[^ ]* .*\p{L}", 1)
        known = {g: TELLING[g].split() + [n.lower() for (_, h), names in GIVEN.items() if h == g for n in names] for g in "mf"}
        titled = F.when(title.isin([t.lower() for t in MALE]), "m").when(title.isin([t.lower() for t in FEMALE]), "f")
        told = F.coalesce(titled, F.when(first.isin(known["m"]), "m").when(first.isin(known["f"]), "f"), F.lit(""))
        gender = F.when((k == "name") & spaced.contains(" "), told).otherwise("")  # a family name alone has none
        canonical = F.when(k == "name", spaced).when(k.isin("email", "ipv6"), F.lower(value)).when(k == "phone", F.regexp_replace(value, "[^0-9+]", "")).when(k.isin("card", "national_id", "iban"), F.regexp_replace(value, "[^0-9A-Za-z]", "")).otherwise(value)
        return F.struct(k.alias("kind"), gender.alias("gender"), prefix.alias("prefix"), value.alias("value"), canonical.alias("canonical"))

    return bind(kind(m), of)


def char(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def nibble(hexes: Column, i: Column) -> Column:
    return F.instr(F.lit(HEX), char(hexes, i)) - 1


def scramble(value: Column, seed: Column, classes: list[str] = ALL_CLASSES) -> Column:
    """Character by character another one of its class or block, by a keyed stream as long as the value. Letters in
    none of them become small consonants; what is no letter stays."""

    def one(c: Column, i: Column, blocks: Column) -> Column:
        hexes, at = F.get(blocks, F.floor(i / 32).cast("int")), (i % 32) * 2 + 1
        r = nibble(hexes, at) * 16 + nibble(hexes, at + 1)
        out = None
        for k in classes:
            pick = F.substring(F.lit(k), r % len(k) + 1, F.lit(1))
            inside = F.instr(F.lit(k), c) > 0
            out = F.when(inside, pick) if out is None else out.when(inside, pick)
        code = F.ascii(c)
        for first, last in RANGES:
            made = first + (code - first + 1 + r * 79) % (last - first)
            out = out.when((code >= first) & (code < last), F.decode(F.unhex(F.lpad(F.hex(made), 4, "0")), "UTF-16BE"))
        plain = CLASSES[2]
        return out.when(c.rlike(r"\p{L}") & F.lit(classes != [HEX]), F.substring(F.lit(plain), r % len(plain) + 1, F.lit(1))).otherwise(c)

    def stream(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.length(value) / 32).cast("int")), lambda j: F.sha2(F.concat_ws("|", digest, j.cast("string")), 256))

    return bind(bind(F.sha2(seed, 256), stream), lambda blocks: F.array_join(F.transform(chars(value), lambda c, i: one(c, i, blocks)), ""))


def check_digit(digits: Column) -> Column:
    """The Luhn digit that completes digits."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = char(digits, i).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def check_pair(country: Column, rest: Column) -> Column:
    """The two digits that make an account number of a country leave 1 modulo 97."""
    whole = F.concat(rest, country, F.lit("00"))

    def step(a: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.upper(char(whole, i))) - 1
        return (a * F.when(v < 10, 10).otherwise(100) + v) % 97

    return F.lpad((98 - F.aggregate(F.sequence(F.lit(1), F.length(whole)), F.lit(0), step)).cast("string"), 2, "0")


def pick(names: list[str], seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.pmod(F.xxhash64(F.sha2(seed, 256)), F.lit(len(names))).cast("int") + 1)


def surrogate(k: Column, gender: Column, canonical: Column, n: Column, key: str) -> Column:
    """The n-th surrogate of an entity, in canonical form: what is secret of it is scrambled, the rest made anew."""
    seed = F.concat_ws("|", F.lit(key), k, canonical, n.cast("string"))
    tail = lambda keep: F.substring(canonical, F.lit(keep + 1), F.length(canonical))
    at, code, words = F.instr(canonical, "@"), F.regexp_extract(canonical, COUNTRY, 0), F.split(canonical, " ")
    domain = F.substring(canonical, at + 1, F.length(canonical))
    host, top = F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", 1), F.regexp_extract(domain, r"(\.[^.]+)$", 1)
    hidden = (
        F.when(k == "email", F.substring(canonical, F.lit(1), at - 1))
        .when(k == "card", F.substring(canonical, F.lit(2), F.length(canonical) - 2))
        .when(k.isin("access_key", "iban"), tail(4))
        .when(k == "phone", F.substring(canonical, F.length(code) + 1, F.length(canonical)))
        .otherwise(canonical)
    )
    hexes = (k == "ipv6") | ((k == "secret") & canonical.rlike("^[0-9a-f]+$"))
    made = F.when(hexes, scramble(hidden, seed, [HEX])).otherwise(scramble(hidden, seed))
    script = F.when(canonical.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canonical.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    # a family name keeps its surrogate while given names are tried
    token = lambda w, turn: F.concat_ws("|", F.lit(key), F.lit("name"), w, turn.cast("string"))

    def given(w: Column) -> Column:
        one, out = token(w, n), None
        for (s, g), names in GIVEN.items():
            this, two = (script == s) & (gender == g), F.when(w.contains("-"), F.concat(F.lit("-"), pick(names, F.concat(one, F.lit("|2"))))).otherwise("")
            new = F.concat(pick(names, one), two)
            out = F.when(this, new) if out is None else out.when(this, new)
        return out

    def word(w: Column, i: Column) -> Column:
        small, several = w.isin(PARTICLES) | w.rlike(r"^\p{L}\.?$"), F.size(words) > 1
        again = scramble(w, token(w, F.when(several, n - n % 4).otherwise(n)))
        grown = F.when((n >= STRICT_ROUNDS) & (i == F.size(words) - 1), more(script)).otherwise("")
        return F.when(w.isin(PARTICLES) & (i < F.size(words) - 1), w).when(several & (i == 0) & ~small, given(w)).otherwise(F.concat(again, grown))

    def more(alphabet: Column) -> Column:
        drawn = F.substring(F.sha2(F.concat(seed, F.lit("|more")), 256), F.lit(1), n - STRICT_ROUNDS + 1)
        letters = [F.call_function("translate", drawn, F.lit(HEX), F.lit(MORE[a])) for a in MORE]
        return F.when(alphabet == "cyrillic", letters[1]).when(alphabet == "greek", letters[2]).when(alphabet == "digits", F.call_function("translate", drawn, F.lit("abcdef"), F.lit("135792"))).when(alphabet == "hex", drawn).otherwise(letters[0])

    late = n >= STRICT_ROUNDS
    longer = F.when(late & (k == "email"), more(script)).when(late & (k == "phone"), more(F.lit("digits"))).when(late & (k == "secret"), more(F.when(canonical.rlike("^[0-9]+$"), "digits").when(hexes, "hex").otherwise("latin"))).otherwise("")
    in_full = F.regexp_replace(F.substring(F.sha2(seed, 256), 1, 32), "(.{4})(?=.)", "$1:")
    octets = F.sha2(seed, 256)
    ip = F.concat_ws(".", (11 + (nibble(octets, F.lit(1)) * 16 + nibble(octets, F.lit(2))) % 80).cast("string"), *((1 + (nibble(octets, F.lit(i)) * 16 + nibble(octets, F.lit(i + 1))) % 254).cast("string") for i in (3, 5, 7)))
    country = F.substring(canonical, 1, 2)

    def whole(x: Column) -> Column:
        digits = F.concat(F.substring(canonical, F.lit(1), F.lit(1)), x)
        return (
            F.when(k == "email", F.concat(x, longer, F.lit("@"), scramble(host, F.concat_ws("|", F.lit(key), F.lit("domain"), host)), top))
            .when(k == "ip", ip)
            .when(k == "card", F.concat(digits, check_digit(digits)))
            .when(late & (k == "ipv6"), in_full)
            .when(k == "access_key", F.concat(F.substring(canonical, F.lit(1), F.lit(4)), x))
            .when(k == "phone", F.concat(code, x, longer))
            .when(k == "iban", F.concat(country, check_pair(country, x), x))
            .otherwise(F.concat(x, longer))
        )

    return F.when(k == "name", F.array_join(F.transform(words, word), " ")).otherwise(bind(made, whole))


def cased(c: Column, x: Column) -> Column:
    return F.when(c != F.lower(c), F.upper(x)).otherwise(F.coalesce(x, F.lit("")))


def written(old: Column, new: Column) -> Column:
    """A word of a surrogate in the capitals of the word that it replaces; given names have their own."""
    capitals = (old == F.upper(old)) & old.rlike(r"\p{L}{2}")
    return F.when(capitals, F.upper(new)).when(new != F.lower(new), new).otherwise(F.array_join(F.zip_with(chars(old), chars(new), cased), ""))


def rendered(m: Column, s: Column) -> Column:
    """A surrogate in the writing of a mention: its prefix, separators and capitals."""
    value, plain = m["value"], F.regexp_replace(s, "[^0-9A-Za-z]", "")

    def filled(i: Column) -> Column:
        c = char(value, i)
        done = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), char(plain, done)).otherwise(c)

    places = F.sequence(F.lit(1), F.length(value))
    rest = F.length(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
    numeric = F.concat(F.array_join(F.transform(places, filled), ""), F.substring(plain, rest + 1, F.length(plain)))
    email = F.array_join(F.zip_with(chars(value), chars(s), cased), "")
    gaps = F.regexp_extract_all(value, F.lit(r"[\s\x{A0}]+"), F.lit(0))
    name = F.array_join(F.transform(F.zip_with(F.split(value, r"[\s\x{A0}]+"), F.split(s, " "), written), lambda w, i: F.concat(w, F.coalesce(F.get(gaps, i), F.lit("")))), "")
    return F.concat(m["prefix"], F.when(m["kind"].isin("phone", "card", "national_id", "iban"), numeric).when(m["kind"].isin("email", "ipv6"), email).when(m["kind"] == "name", name).otherwise(s))


def assign(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """entities (kind, gender, canonical), distinct -> with their surrogate.

    A round proposes a surrogate for each open entity; of equal proposals the smallest entity keeps it, and none may
    be a real entity or given away before. The others go on to the next round. Where a format of fixed length has no
    surrogate left, MOST_ROUNDS ends the search with an error.
    """
    real = entities.select("kind", F.lower("canonical").alias("folded")).distinct()
    made = surrogate(F.col("kind"), F.col("gender"), F.col("canonical"), F.col("round"), key)
    one = ["kind", "gender", "canonical"]
    open_, done = entities, None
    for n in itertools.count():
        proposed = scratch.table(open_.withColumn("round", F.lit(n)).withColumn("surrogate", made).withColumn("folded", F.lower("surrogate")).drop("round"), "proposed")
        first = proposed.groupBy("kind", "folded").agg(F.min(F.struct("canonical", "gender")).alias("winner"))
        free = first.join(real, ["kind", "folded"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", F.lower("surrogate").alias("folded")), ["kind", "folded"], "left_anti")
        won = proposed.join(free.select("kind", "winner.gender", "winner.canonical"), one, "left_semi").select(*one, "surrogate")
        done = scratch.table(won if done is None else done.unionByName(won), "done")
        open_ = scratch.table(proposed.join(done, one, "left_anti").select(*one), "open")
        if open_.isEmpty():
            return done
        if n >= MOST_ROUNDS:
            raise ValueError(f"no surrogate is left for entities of kind {open_.first()['kind']}")


def called(value: Column, new: Column) -> Column:
    """What stands for a name wherever its document has it: [(key, first, last)], keys in small letters. First and last
    word together have both; a word alone that isn't a common one has `last`."""
    a, b = F.split(F.lower(value), r"[\s\x{A0}]+"), F.split(new, " ")
    entry = lambda k, x, y: F.struct(k.alias("key"), x.alias("first"), y.alias("last"))
    first, last = F.element_at(a, 1), F.element_at(a, -1)
    none = F.lit(None).cast("string")
    both = F.when(F.size(a) > 1, entry(F.concat_ws(" ", first, last), F.element_at(b, 1), F.element_at(b, -1)))
    alone = [F.when(~w.isin(COMMON + PARTICLES) & ~w.rlike(r"^\p{L}?\.?$"), entry(w, none, x)) for w, x in ((last, F.element_at(b, -1)), (first, F.element_at(b, 1)))]
    return F.filter(F.array(both, *alone), lambda x: x.isNotNull())


def found(entries: Column, key: Column, of: Callable[[Column], Column] = lambda e: e) -> Column:
    """The first of the entries (sorted) with this key, by bisection, or null."""
    span = F.struct(F.lit(0).alias("lo"), F.size(entries).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = (s["lo"] < s["hi"]) & (of(F.get(entries, mid)) < key)
        return F.struct(F.when(less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(less | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(entries) + 1)).cast("int"))
    at = F.aggregate(steps, span, halve, lambda s: s["lo"])
    return bind(F.get(entries, at), lambda e: F.when(of(e) == key, e))


def surrogates(docs: DataFrame, key: str, text_col: str = "text", *, count: str | None = None) -> DataFrame:
    """docs with every mention in `text_col` replaced; all columns stay. count: a column for the number of mentions,
    which takes the place of one of that name.

    The pattern runs over each text once. A name found after its title is also replaced where the same document has it,
    its first and last word, or one of these without one; alone, words of COMMON stay, and so do words that the document
    has in small letters too. The words of a text are looked up by bisection, so many names cost no more for each word
    than their logarithm. One name with titles of both genders is two entities; without a gender it joins the only one
    known. Null and empty texts stay as they are. Texts are matched by content, so null
    ids and repeated rows need no care, and further columns may have any name. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.col("text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    # mentions are set off by a mark that depends on the text, so the text doesn't have it: parts alternate between plain and mention
    marked = rows.withColumn("mark", F.concat(F.lit("\x01"), F.hex(F.xxhash64("text"))))
    parts = F.split(F.regexp_replace(text, F.lit(PATTERN), F.concat("mark", F.lit("$0"), "mark")), F.col("mark"))
    cut = marked.withColumn("parts", parts).select(F.monotonically_increasing_id().alias("id"), "row", "mark", F.when(F.size("parts") > 1, F.col("parts")).alias("parts"))
    cut = scratch.table(cut, "cut")
    hit = cut.where("parts is not null")
    each = F.transform(F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2)), lambda i: F.get("parts", i))
    mentions = hit.select("id", F.posexplode(each).alias("place", "mention")).select("id", "place", parsed(F.col("mention")).alias("m"))
    names = ["kind", "canonical", "gender"]
    mentions = scratch.table(mentions.select("id", "place", "m", *(F.col(f"m.{c}").alias(c) for c in names)), "mentions")
    seen = mentions.groupBy(*names).agg(F.count("*").alias("copies"))
    known, same = F.when(F.col("gender") != "", F.col("gender")), Window.partitionBy("kind", "canonical")  # three rows at most
    only = F.when(F.min(known).over(same) == F.max(known).over(same), F.min(known).over(same))
    entities = scratch.table(seen.withColumn("who", F.coalesce(known, only, F.lit(""))), "entities")
    assigned = assign(entities.select("kind", F.col("who").alias("gender"), "canonical").distinct(), key, scratch)
    given = entities.join(assigned.withColumnRenamed("gender", "who"), ["kind", "who", "canonical"]).drop("who")
    mine = join_spread(mentions, given, names, "copies", mentions.count())
    said = F.struct("place", rendered(F.col("m"), F.col("surrogate")).alias("said"), F.when(F.col("kind") == "name", called(F.col("m.value"), F.col("surrogate"))).alias("names"))
    new = mine.select("id", said.alias("s")).groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    entries = F.flatten(F.filter("s.names", lambda x: x.isNotNull()))
    new = new.select("id", F.col("s.said").alias("said"), F.sort_array(entries).alias("names"))
    joined = hit.join(new.hint("merge"), "id")
    # words that the document has in small letters
    lower = F.regexp_extract_all(F.array_join(F.filter("parts", lambda _, i: i % 2 == 0), " "), F.lit(r"(?<![\p{L}\p{M}])\p{Ll}[\p{L}\p{M}]*+"), F.lit(0))
    small = F.sort_array(F.array_intersect(F.transform("names", lambda e: e["key"]), lower))
    alone = lambda few: F.filter("names", lambda e: e["first"].isNotNull() | found(few, e["key"]).isNull())
    usable = F.when(F.size("names") > 0, bind(small, lambda few: F.when(F.size(few) > 0, alone(few)).otherwise(F.col("names")))).otherwise(F.col("names"))

    def plain(part: Column, names: Column) -> Column:
        """Names that were found elsewhere in the document, replaced too: words and what lies between take turns."""

        def word(pieces: Column, w: Column, i: Column) -> Column:
            key, entry = F.lower(w), lambda k: found(names, k, lambda e: e["key"])
            blank = lambda j: F.get(pieces, j).rlike(rf"^{_GAP}$")
            before = F.when((i > 1) & blank(i - 1), entry(F.concat_ws(" ", F.lower(F.get(pieces, i - 2)), key))["last"])
            after = F.when(blank(i + 1), entry(F.concat_ws(" ", key, F.lower(F.get(pieces, i + 2))))["first"])
            return bind(F.coalesce(after, before, entry(key)["last"]), lambda x: F.when(x.isNull(), w).otherwise(written(w, x)))

        pieces = F.split(F.regexp_replace(part, F.lit(rf"(?<![\p{{L}}\p{{M}}]){_WORD}"), F.concat("mark", F.lit("$0"), "mark")), F.col("mark"))
        whole = bind(pieces, lambda p: F.array_join(F.transform(p, lambda x, i: F.when(i % 2 == 1, word(p, x, i)).otherwise(x)), ""))
        return F.when(F.size(names) == 0, part).otherwise(whole)

    said = lambda i: F.get("said", F.floor(i / 2).cast("int"))
    clean = bind(usable, lambda names: F.array_join(F.transform("parts", lambda x, i: F.when(i % 2 == 1, said(i)).otherwise(plain(x, names))), ""))
    out = joined.select("row", clean.alias("text"), F.size("said").alias("n")).unionByName(cut.where("parts is null").select("row", F.col(f"row.`{text_col}`").cast("string").alias("text"), F.lit(0).alias("n")))
    made = [(F.col("text") if c == text_col else F.col("n") if c == count else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return out.select(*made, *([F.col("n").alias(count)] if count and count not in docs.columns else []))
