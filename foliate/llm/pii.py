"""Personal data replaced by surrogates, in Spark functions alone.

One pattern finds e-mail addresses, telephone, card, social security and account
numbers, IP addresses, keys, secrets, and names after a form of address.  An entity's
canonical form (digits of a number, lower case of an address, a name or hexadecimal
digits) is replaced under a key, by HMAC-SHA-512, and put into the mention's format.

Numbers, addresses, keys and secrets go through a keyed permutation of all forms of
their shape (a Feistel network over their characters, each added to within its own
alphabet): type, length, punctuation, case, script, country code and the rightness of
check digits stay, and different entities get different surrogates by construction.
The permutation has no fixed point.  A surrogate that the corpus holds as an entity
itself is followed along the permutation to a form that it doesn't hold, as brackets are
matched, so that no two end alike (see ``_walked``); where a shape's forms are nearly
all taken, the first surrogate stays, which is another entity's form but nobody else's
surrogate.

Names are keyed by their words and by the gender that the document's forms of address
give them, so 'Mr John Smith', 'Dr John Smith' and, in the same document, a bare 'John
Smith', 'John' or 'Smith' become parts of one name; the surname is the same for all its bearers.  Given names come
from lists by gender and script.  Names that clash, and social security numbers (which
all begin with 9 then), are told apart by their rank among those that clash: an added
syllable or another first digit.  Ranks and followed forms are the only tables; they are
looked up by a join, and without any texts are rewritten in place.

Defined results: null and empty texts stay as they are; repeated rows get equal texts;
an empty table gives no rows; all columns of the input are kept, and
``n_entities`` and ``entities`` are replaced if it has them; bare names aren't counted
in them.  Names are only known by a form of address (capitalised, one or several in a row), and
with them the full name, the given name and the surname wherever they stand alone in the document;
a person known by one word that is a common word as well (``COMMON``) is not replaced where that
word stands alone.  A word that is itself a form of address is never a name; two notations of one IPv6 address
are two entities; letters beyond the Latin and Cyrillic alphabets stay within numbers
and secrets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm import common

#: Forms of address by gender, and the names and syllables that surrogates are made of.
MALE_FORMS = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Don", "г-н", "господин"]
FEMALE_FORMS = ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Signora", "Doña", "г-жа", "госпожа"]
OTHER_FORMS = ["Mx", "Dr", "Prof", "Professor"]
MALE_NAMES = ["Adam", "Alan", "Boris", "Carl", "Daniel", "David", "Edgar", "Felix", "Frank", "George", "Henry", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor", "Walter"]
FEMALE_NAMES = ["Agnes", "Alice", "Bella", "Carla", "Clara", "Diana", "Edith", "Emma", "Flora", "Grace", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Paula", "Rosa", "Sarah", "Teresa", "Vera", "Wilma"]
OTHER_NAMES = ["Alex", "Andrea", "Charlie", "Dana", "Eden", "Gale", "Jamie", "Jordan", "Kim", "Lee", "Morgan", "Noel", "Quinn", "Robin", "Sam", "Taylor"]
CYRILLIC_MALE_NAMES = ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел"]
CYRILLIC_FEMALE_NAMES = ["Алла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения", "Лидия", "Нина", "Ольга", "Софья"]
LATIN_SYLLABLES = [c + v for c in "bdfgklmnprstv" for v in "aeiou"]
CYRILLIC_SYLLABLES = [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"]
LATIN_ENDINGS, CYRILLIC_ENDINGS = ["n", "r", "s", "l", "ck", "nd", "rt", "m"], ["в", "н", "к", "р", "лин", "ков", "ман", "тов"]
#: Alphabets within which a character is replaced.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ", "àáâäçèéêëíîïñóôöúûü", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÛÜ"]
HEXADECIMAL, BASE32, NOT_BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0189"
EVERY = "".join([*ALPHABETS, HEXADECIMAL, BASE32, NOT_BASE32])

#: Names that are words as well: alone, and without a full name beside them, they are read as words.
COMMON = set("april august autumn baker best bill black blue brown church cook day dean duke faith fall field fisher forest frank grace gray green grey hall hill hope hunter joy juin juli juillet june junge jung king lake long lord mai march mark mars marsh may mayo mills moon noble north page pearl pope prince rich rose ruby rush sand sharp short smart snow sommer south spring stein stone storm summer sun swift violet wall ward waters weiss west white will winter wolf wood woods young".split())

#: One form of address or several in a row, none of which is a name then.
_FORMS = "(?:(?:" + "|".join(sorted([*MALE_FORMS, *FEMALE_FORMS, *OTHER_FORMS], key=lambda x: (-len(x), x))) + r")(?:\. ?| ))++"
_LOUD_FORMS = r"(?:(?:MRS|MR|DR)(?:\. ?| )|(?:MS|MX|PROF)\. ?)++"
_WORD = r"\p{Lu}(?=[\p{L}'’-]*\p{Ll})\p{L}*(?:['’-]\p{Lu}\p{L}+)*(?!\p{L})"
_LOUD_WORD = r"\p{Lu}(?=['’]?\p{Lu})\p{Lu}*(?:['’-]\p{Lu}{2,})*(?!\p{L})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: In either case. A token that is one is found as such, so it has one surrogate wherever it stands; no account number is one.
_HEX = r"(?=[0-9A-Fa-f]*\d)(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])"
_QUARTET = "[0-9A-Fa-f]{1,4}"
#: In the order in which they are tried at one place.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "KEY": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "SECRET": rf"(?i:password|passwd|pwd|secret|api_?key|access_?token|(?:auth_?)?token(?!\s{{0,3}}[=:]\s{{0,3}}[\"']?{_HEX}))\s{{0,3}}[=:]\s{{0,3}}[\"']?[^\s\"',;<>]{{4,}}",
    "HEX": _HEX,
    "IBAN": r"(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?=[a-z]{2}\d{2}(?:[a-z ]{0,6}\d){8})[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){3,7}(?: ?[a-z0-9]{1,3})?)(?![A-Za-z0-9])",
    "IPV6": rf"(?:(?:{_QUARTET}:){{7}}{_QUARTET}|(?=[0-9A-Fa-f:]*::)(?=(?:[0-9A-Fa-f]*:){{3}})(?:{_QUARTET}:){{1,6}}(?::{_QUARTET}){{1,6}})(?![A-Za-z0-9:])",
    "IPV4": rf"(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?![A-Za-z0-9]|\.\d)",
    "SSN": r"\d{3}-\d{2}-\d{4}(?![A-Za-z0-9]|-\d)",
    "CARD": r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![A-Za-z0-9]|-\d)",
    "PHONE": r"(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![A-Za-z0-9]|-\d)",
    "PERSON": rf"(?:{_FORMS}{_WORD}(?: {_WORD})?|{_LOUD_FORMS}{_LOUD_WORD}(?: {_LOUD_WORD})?)",
}
_START = r"(?<![\p{L}\p{N}_@])"
ANY = _START + "(?:" + "|".join(PATTERNS.values()) + ")"
#: Rows of looked-up surrogates up to which they are broadcast, rounds of the permutation, and steps along it.
BROADCAST_ROWS, ROUNDS, STEPS = 100_000, 3, 6
#: Names that inputs are not expected to have.
FOUND, ROW, SHA, FIRST, NEW, PARTS, TASKS = (f"__pii_{x}" for x in ("found", "row", "sha", "first", "new", "parts", "tasks"))
_OWN = {x.lower() for x in (FOUND, ROW, SHA, FIRST, NEW, PARTS, TASKS)}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


class Keyed:
    """HMAC-SHA-512 as a column expression, 128 hexadecimal digits."""

    def __init__(self, key: str):
        raw = key.encode()
        raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
        self.inner, self.outer = (F.lit(bytearray(b ^ x for b in raw)) for x in (0x36, 0x5C))

    def __call__(self, *parts: Column | str) -> Column:
        message = F.encode(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)), "UTF-8")
        return F.sha2(F.concat(self.outer, F.unhex(F.sha2(F.concat(self.inner, message), 512))), 512)


def _number(digest: Column, at: Column | int, n: Column | int) -> Column:
    """A number below ``n`` from the ``at``-th four digits of a digest."""
    place = (F.lit(at) if isinstance(at, int) else at) % 32 * 4 + 1
    return F.pmod(F.conv(F.substring(digest, place, F.lit(4)), 16, 10).cast("int"), F.lit(n) if isinstance(n, int) else n)


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


# The permutation ---------------------------------------------------------------------------------


def _half(tasks: Column, keyed: Keyed, turn: int, sign: int) -> Column:
    """Every task's places of one parity, added to by what the others are."""
    mine = turn % 2

    def one(task: Column) -> Column:
        others = F.array_join(F.transform(F.filter(task["places"], lambda x, i: i % 2 != mine), lambda x: x["v"].cast("string")), ",")
        moved = lambda d: F.transform(task["places"], lambda x, i: F.when((i % 2 == mine) & (x["n"] > 1), x.withField("v", F.pmod(x["v"] + sign * _number(d, i, x["n"]), x["n"]))).otherwise(x))
        return F.when(F.size(task["places"]) > 0, task.withField("places", _let(keyed(task["tweak"], str(turn), others), moved))).otherwise(task)

    return F.transform(tasks, one)


def _one_more(tasks: Column) -> Column:
    """Every task's first place that has two values or more, moved to the next one."""
    first = lambda task: F.array_position(F.transform(task["places"], lambda x: x["n"] > 1), True) - 1
    return F.transform(tasks, lambda task: task.withField("places", _let(first(task), lambda f: F.transform(task["places"], lambda x, i: F.when(i == f, x.withField("v", F.pmod(x["v"] + 1, x["n"]))).otherwise(x)))))


def _permuted(df: DataFrame, name: str, keyed: Keyed) -> DataFrame:
    """``df`` with the places of column ``name`` moved by a keyed permutation without fixed points.

    It is a Feistel network, then one more for the first place that has two values, then
    the network undone: a conjugate of a step that moves everything moves everything.
    A column for each step keeps the expressions flat.
    """
    steps = [*(lambda c, t=t: _half(c, keyed, t, 1) for t in range(ROUNDS)), _one_more, *(lambda c, t=t: _half(c, keyed, t, -1) for t in reversed(range(ROUNDS)))]
    for step in steps:
        df = df.withColumn(name, step(F.col(name)))
    return df


def _place(kind: Column, c: Column) -> Column:
    """A piece of an entity as ``start``, ``n`` and ``v``: the ``v``-th of the ``n`` characters of ``EVERY`` from ``start`` on, or an IPv4 number ``v`` above ``start``."""
    lot = lambda start, n, v: F.struct(F.lit(start).alias("start"), F.lit(n).alias("n"), v.alias("v"))
    octet = F.when(c == "0", lot(0, 1, F.lit(0)))
    for digits, low, n in ((1, 1, 9), (2, 10, 90), (3, 100, 156)):
        octet = octet.when((kind == "IPV4") & (F.length(c) == digits), lot(low, n, c.cast("int") - low))

    def of(at: Column) -> Column:
        out, start = lot(0, 1, F.lit(0)), 0
        for a in [*ALPHABETS, HEXADECIMAL, BASE32, NOT_BASE32]:
            out = F.when((at > start) & (at <= start + len(a)), lot(start, len(a), at - start - 1)).otherwise(out)
            start += len(a)
        return out

    def within(alphabet: str) -> Column:
        return _let(F.instr(F.lit(alphabet), c), lambda at: F.when(at > 0, at + F.lit(EVERY.rindex(alphabet))).otherwise(0))

    place = _let(F.when(kind.isin("HEX", "IPV6"), within(HEXADECIMAL)).when(kind == "KEY", within(BASE32 + NOT_BASE32)).otherwise(within("".join(ALPHABETS))), of)
    return F.when(kind == "IPV4", octet).otherwise(place)


def _task(kind: Column, text: Column, tweak: Column) -> Column:
    """``text`` cut into pieces with their places, ready to be permuted among all texts of its shape."""
    pieces = F.when(F.length(text) == 0, F.array().cast("array<string>")).when(kind == "IPV4", F.split(text, r"\.")).otherwise(F.split(text, ""))
    return F.struct(kind.alias("kind"), tweak.alias("tweak"), _let(pieces, lambda p: F.transform(p, lambda c: _let(_place(kind, c), lambda at: F.struct(c.alias("c"), at["start"].alias("start"), at["n"].alias("n"), at["v"].alias("v"))))).alias("places"))


def _text(task: Column) -> Column:
    """What a task's places stand for."""
    piece = lambda x: F.when(x["n"] <= 1, x["c"]).when(task["kind"] == "IPV4", (x["start"] + x["v"]).cast("string")).otherwise(F.substring(F.lit(EVERY), x["start"] + x["v"] + 1, F.lit(1)))
    return _let(F.transform(task["places"], piece), lambda x: F.when(task["kind"] == "IPV4", F.array_join(x, ".")).otherwise(F.array_join(x, "")))


def _luhn(body: Column) -> Column:
    """The check digit of ``body``."""
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(F.length(body) - i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(-F.aggregate(F.transform(F.split(body, ""), weigh), F.lit(0), lambda a, x: a + x), F.lit(10))


def _iban(country: Column, account: Column) -> Column:
    """The check digits of an account."""
    def add(a: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))

    return 98 - F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), add)


# Names -------------------------------------------------------------------------------------------


def _extra(number: Column, syllables: list[str]) -> Column:
    """A number from 1 on in syllables, none for 0."""
    n = len(syllables)
    digit = lambda k: F.when(number >= n**k, _pick(syllables, F.pmod(F.floor(number / n**k), F.lit(n)).cast("int"))).otherwise("")
    return F.when(number > 0, F.concat(*(digit(k) for k in range(4, -1, -1)))).otherwise("")


def _surname(token: Column, gender: Column, number: Column, keyed: Keyed) -> Column:
    def made(d: Column) -> Column:
        def of(syllables: list[str], endings: list[str]) -> Column:
            return F.initcap(F.concat(*(_pick(syllables, _number(d, k, len(syllables))) for k in range(4)), _extra(number, syllables), _pick(endings, _number(d, 9, len(endings)))))

        return F.when(token.rlike("[а-яё]"), F.concat(of(CYRILLIC_SYLLABLES, CYRILLIC_ENDINGS), F.when((gender == "f") & token.endswith("а"), "а").otherwise(""))).otherwise(of(LATIN_SYLLABLES, LATIN_ENDINGS))

    return _let(keyed("surname", token), made)


def _given(token: Column, gender: Column, number: Column, keyed: Keyed) -> Column:
    def made(d: Column) -> Column:
        of = lambda names: _pick(names, _number(d, 0, len(names)))
        cyrillic = F.concat(F.when(gender == "f", of(CYRILLIC_FEMALE_NAMES)).otherwise(of(CYRILLIC_MALE_NAMES)), _extra(number, CYRILLIC_SYLLABLES))
        latin = F.concat(F.when(gender == "m", of(MALE_NAMES)).when(gender == "f", of(FEMALE_NAMES)).otherwise(of(OTHER_NAMES)), _extra(number, LATIN_SYLLABLES))
        return F.when(token.rlike("[а-яё]"), cyrillic).otherwise(latin)

    return _let(keyed("given", gender, token), made)


def _person(own: Column, keyed: Keyed, given: Column | None = None, surname: Column | None = None) -> Column:
    """A name's surrogate; ``given`` and ``surname``: ranks among those that clash."""
    none = F.lit(0)
    gender, tokens = F.substring(own, 1, 1), F.split(F.substring(own, 3, 1000), " ")
    last = lambda t: _surname(F.element_at(t, -1), gender, none if surname is None else surname, keyed)
    return _let(tokens, lambda t: F.when(F.size(t) == 1, last(t)).otherwise(F.concat_ws(" ", _given(F.get(t, F.lit(0)), gender, none if given is None else given, keyed), last(t))))


# Entities ----------------------------------------------------------------------------------------


def kind_of(match: Column) -> Column:
    out = F.lit("PERSON")
    for name in reversed([k for k in PATTERNS if k != "PERSON"]):
        out = F.when(match.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def _form(match: Column) -> Column:
    return F.regexp_extract(match, f"^(?:{_FORMS}|{_LOUD_FORMS})", 0)


def _name(match: Column) -> Column:
    return F.substring(match, F.length(_form(match)) + 1, F.length(match))


def _gender(match: Column) -> Column:
    """Of the first form of address that has one."""
    def of(forms: Column) -> Column:
        told = F.transform(forms, lambda f: F.when(f.isin([x.lower() for x in MALE_FORMS]), "m").when(f.isin([x.lower() for x in FEMALE_FORMS]), "f"))
        return F.coalesce(F.get(F.filter(told, lambda g: g.isNotNull()), F.lit(0)), F.lit("x"))

    return _let(F.split(F.lower(_form(match)), "[. ]+"), of)


def _secret_name(match: Column) -> Column:
    return F.regexp_extract(match, r"^[A-Za-z_]+\s*[=:]\s*[\"']?", 0)


def canonical(kind: Column, match: Column) -> Column:
    """What two mentions of one entity share; a name's without its gender."""
    return (
        F.when(kind.isin("CARD", "SSN"), F.regexp_replace(match, "[^0-9]", ""))
        .when(kind == "PHONE", F.concat(F.when(match.startswith("+"), F.concat(F.length(F.regexp_extract(match, r"^\+(\d+?)(?:[ .(-]|\d{9,}$)", 1)).cast("string"), F.lit("+"))).otherwise("0+"), F.regexp_replace(match, "[^0-9]", "")))
        .when(kind.isin("EMAIL", "HEX", "IPV6"), F.lower(match))
        .when(kind == "IBAN", F.upper(F.replace(match, F.lit(" "), F.lit(""))))
        .when(kind == "SECRET", F.substring(match, F.length(_secret_name(match)) + 1, F.length(match)))
        .when(kind == "PERSON", F.lower(F.replace(_name(match), F.lit("’"), F.lit("'"))))
        .otherwise(match)
    )


def surrogates(df: DataFrame, entities: str, out: str, keyed: Keyed) -> DataFrame:
    """``df`` with column ``out``: the canonical form of the first surrogate of each of ``entities`` (structs of ``kind`` and ``own``).

    Cards and accounts keep how far their check digits are from the right ones, so that
    no two that differ in those alone meet.
    """
    def parts(e: Column) -> Column:
        """What stays, what is permuted, and what the permutation depends on besides."""
        kind, own, n = e["kind"], e["own"], F.length(e["own"])
        digits, known = F.split_part(own, F.lit("+"), F.lit(2)), F.split_part(own, F.lit("+"), F.lit(1)).try_cast("int")
        start = F.when(kind == "PHONE", F.substring(digits, F.lit(1), known)).when(kind == "CARD", F.substring(own, 1, 1)).when(kind == "SSN", "9").when(kind == "IBAN", F.substring(own, 1, 2)).when(kind == "KEY", F.substring(own, 1, 4)).otherwise("")
        body = (
            F.when(kind == "PERSON", "").when(kind == "EMAIL", F.split_part(own, F.lit("@"), F.lit(1))).when(kind == "PHONE", F.substring(digits, known + 1, F.length(digits))).when(kind == "CARD", F.substring(own, F.lit(2), n - 2))
            .when(kind == "SSN", F.substring(own, 2, 8)).when(kind.isin("IBAN", "KEY"), F.substring(own, 5, 60)).otherwise(own)
        )
        domain = F.when(kind == "EMAIL", F.split_part(own, F.lit("@"), F.lit(2))).otherwise("")
        return F.struct(kind.alias("kind"), own.alias("own"), start.alias("start"), body.alias("body"), domain.alias("domain"))

    def put(e: Column, m: Column, host: Column) -> Column:
        kind, own, start, n = e["kind"], e["own"], e["start"], F.length(e["own"])
        new, old = F.concat(start, m), F.substring(own, F.lit(1), n - 1)
        card = F.concat(new, F.pmod(_luhn(new) + F.substring(own, n, F.lit(1)).try_cast("int") - _luhn(old), F.lit(10)).cast("string"))
        check = F.pmod(_iban(start, m) + F.substring(own, 3, 2).try_cast("int") - _iban(start, F.substring(own, 5, 60)), F.lit(100))
        return (
            F.when(kind == "PERSON", _person(own, keyed)).when(kind == "EMAIL", F.concat(m, F.lit("@"), host, F.regexp_extract(e["domain"], r"(\.[a-z]+)$", 1)))
            .when(kind == "PHONE", F.concat(F.split_part(own, F.lit("+"), F.lit(1)), F.lit("+"), new)).when(kind == "CARD", card)
            .when(kind == "IBAN", F.concat(start, F.lpad(check.cast("string"), 2, "0"), m)).otherwise(new)
        )

    step = df.withColumn(PARTS, F.transform(entities, parts))
    tweak = lambda e: F.concat_ws("|", e["kind"], F.when(e["kind"] == "EMAIL", e["domain"]).otherwise(e["start"]))
    main = F.transform(PARTS, lambda e: _task(e["kind"], e["body"], tweak(e)))
    hosts = F.transform(PARTS, lambda e: _task(F.lit("HOST"), F.regexp_extract(e["domain"], r"^(.*)(\.[a-z]+)$", 1), F.lit("host")))
    step = _permuted(step.withColumn(TASKS, F.concat(main, hosts)), TASKS, keyed).withColumn(TASKS, F.transform(TASKS, _text))
    made = F.transform(PARTS, lambda e, i: put(e, F.get(F.col(TASKS), i), F.get(F.col(TASKS), i + F.size(PARTS))))
    return step.withColumn(out, made).drop(PARTS, TASKS)


def _refill(original: Column, filling: Column, kind: str = "[0-9A-Za-z]") -> Column:
    """``original`` with its characters of ``kind`` replaced by those of ``filling`` in order."""
    chars = F.split(original, "")
    return _let(F.split(filling, ""), lambda fill: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(f"^{kind}$"), F.coalesce(F.get(fill, F.size(F.filter(F.slice(chars, 1, i), lambda x: x.rlike(f"^{kind}$")))), c)).otherwise(c)), ""))


def render(kind: Column, match: Column, made: Column) -> Column:
    """The surrogate in the format of the mention."""
    cased = lambda text: F.when(F.upper(text) == text, F.upper(made)).otherwise(made)
    account = lambda m: F.when(F.lower(match) == match, F.lower(m)).otherwise(m)
    return (
        F.when(kind.isin("CARD", "SSN"), _refill(match, made, "[0-9]"))
        .when(kind == "PHONE", _refill(match, F.split_part(made, F.lit("+"), F.lit(2)), "[0-9]"))
        .when(kind == "IBAN", account(_refill(match, made)))
        .when(kind == "SECRET", F.concat(_secret_name(match), made))
        .when(kind.isin("EMAIL", "HEX", "IPV6"), cased(match))
        .when(kind == "PERSON", F.concat(_form(match), cased(_name(match))))
        .otherwise(made)
    )


def _entity(match: Column) -> Column:
    return _let(kind_of(match), lambda k: F.struct(k.alias("kind"), canonical(k, match).alias("own"), match.alias("match"), F.when(k == "PERSON", _gender(match)).alias("gender")))


def _gendered(found: Column) -> Column:
    """Names with the gender that any of the document's forms of address gives them."""
    of = lambda g: F.array_distinct(F.transform(F.filter(found, lambda e: e["gender"] == g), lambda e: e["own"]))

    def one(e: Column, men: Column, women: Column) -> Column:
        man, woman = F.array_contains(men, e["own"]), F.array_contains(women, e["own"])
        gender = F.when(man & ~woman, "m").when(woman & ~man, "f").otherwise(e["gender"])
        return F.struct(e["kind"].alias("kind"), F.when(e["kind"] == "PERSON", F.concat(gender, F.lit("|"), e["own"])).otherwise(e["own"]).alias("own"), e["match"].alias("match"))

    return _let(of("m"), lambda men: _let(of("f"), lambda women: F.transform(found, lambda e: one(e, men, women))))


def found(docs: DataFrame) -> DataFrame:
    """``docs`` with column ``FOUND``, the kinds, canonical forms and mentions in each text."""
    all_ = F.transform(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(ANY), 0), _entity)
    return docs.withColumn(FOUND, all_).withColumn(FOUND, _gendered(F.col(FOUND)))


def _first(df: DataFrame, own: str, keyed: Keyed) -> DataFrame:
    """``df`` with the first surrogate of ``kind`` and column ``own`` as ``FIRST``."""
    return surrogates(df.withColumn(FOUND, F.array(F.struct("kind", F.col(own).alias("own")))), FOUND, FIRST, keyed).withColumn(FIRST, F.get(F.col(FIRST), F.lit(0))).drop(FOUND)


def _walked(entities: DataFrame, keyed: Keyed) -> DataFrame:
    """``kind, own, made`` of entities (stored ``kind, own, made``) whose first surrogate is an entity of the corpus.

    Along the permutation, entities of the corpus are opening brackets and other forms
    closing ones; an entity's surrogate is the bracket that closes its own.  Those that
    aren't closed within ``STEPS`` keep their first surrogate: it is an entity's form, so
    no closing bracket, and the first surrogate of no other.
    """
    taken = entities.select("kind", F.col("own").alias("made"), F.lit(True).alias("real"))
    now = entities.join(taken, ["kind", "made"], "left_semi").select("kind", "own", "made", F.lit(2).alias("depth"))
    closed = []
    for _ in range(STEPS):
        now = common.store(now, "pii_walk")
        if now.isEmpty():
            break
        step = _first(now, "made", keyed).select("kind", "own", F.col(FIRST).alias("made"), "depth")
        step = step.join(taken, ["kind", "made"], "left").select("kind", "own", "made", F.when(F.col("real"), F.col("depth") + 1).otherwise(F.col("depth") - 1).alias("depth"))
        step = common.store(step, "pii_walk")
        closed.append(step.filter("depth = 0").select("kind", "own", "made"))
        now = step.filter("depth > 0")
    out = entities.select("kind", "own", "made").limit(0)
    for part in closed:
        out = out.union(part)
    return out


def _ranked(df: DataFrame, *groups: str) -> DataFrame:
    """``df`` (distinct rows) with ``number``, the rank of ``own`` within its group, from 0 on."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(*groups).orderBy("own")) - 1)


def exceptions(docs: DataFrame, keyed: Keyed) -> DataFrame:
    """``kind, own, made`` of entities whose surrogate isn't their first one."""
    each = found(docs.select("text")).select(F.explode(FOUND).alias("e")).select("e.kind", "e.own").distinct()
    entities = common.store(_first(common.store(each, "pii_mentions"), "own", keyed).select("kind", "own", F.col(FIRST).alias("made")), "pii_entities")
    walked = _walked(entities.filter("kind not in ('PERSON', 'SSN')"), keyed)
    # At most ten numbers share their last eight digits.
    ssn = _ranked(entities.filter("kind = 'SSN'"), "made").filter("number > 0").select("kind", "own", F.concat((9 - F.col("number")).cast("string"), F.substring("made", 2, 8)).alias("made"))
    people = entities.filter("kind = 'PERSON'").select("own", F.substring("own", 1, 1).alias("gender"), F.substring_index("own", " ", 1).alias("start"), F.regexp_extract("own", r"([^ |]+)$", 1).alias("last"))
    # Surnames that clash, then full names with one surname and one given surrogate.
    lasts = people.groupBy("last").agg(F.min("last").alias("own")).select("last", "own", _surname(F.col("last"), F.lit("x"), F.lit(0), keyed).alias("made"))
    lasts = common.store(_ranked(lasts, "made").filter("number > 0").select("last", F.col("number").alias("surname")), "pii_surnames")
    full = people.filter(F.col("own").contains(" ")).withColumn("made", _given(F.substring("start", 3, 1000), F.col("gender"), F.lit(0), keyed))
    givens = _ranked(full, "gender", "made", "last").filter("number > 0").select("own", F.col("number").alias("given"))
    marked = people.select("own", "last").join(givens, "own", "left").join(lasts, "last", "left").filter("given is not null or surname is not null")
    zero = lambda c: F.coalesce(c, F.lit(0))
    names = marked.select(F.lit("PERSON").alias("kind"), "own", _person(F.col("own"), keyed, zero("given"), zero("surname")).alias("made"))
    return walked.union(ssn).union(names)


def _woven(parts: Column, new: Column) -> Column:
    """``parts`` with ``new`` between them in order."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(new, i), F.lit("")))), "")


def _rewritten(text: Column, new: Column) -> Column:
    """``text`` with its mentions replaced by ``new`` in order, and bare names of the people among them by theirs.

    A person's full name, given name and surname are replaced wherever they stand alone; of a person known by one word
    alone, that word is, unless it is a ``COMMON`` one.
    """
    def entry(find: Column, put: Column) -> Column:
        return F.struct(find.alias("find"), put.alias("put"))

    def bare_names(e: Column, i: Column) -> Column:
        def of(own: Column, put: Column) -> Column:
            tokens, puts = F.split(own, " "), F.split(put, " ")
            single = F.when(F.lower(own).isin(sorted(COMMON)), F.array().cast("array<struct<find:string,put:string>>")).otherwise(F.array(entry(own, put)))
            return F.when(F.size(tokens) == 1, single).otherwise(F.array(entry(own, put), entry(F.get(tokens, F.lit(0)), F.get(puts, F.lit(0))), entry(F.element_at(tokens, -1), F.element_at(puts, -1))))

        return F.when(e["kind"] == "PERSON", _let(_name(e["match"]), lambda own: _let(_name(F.get(new, i)), lambda put: of(own, put)))).otherwise(F.array().cast("array<struct<find:string,put:string>>"))

    people = F.flatten(F.transform(FOUND, bare_names))

    def all_parts(parts: Column) -> Column:
        def bare(own: Column) -> Column:
            finds = F.transform(own, lambda p: p["find"])
            pattern = F.concat(F.lit(_START + "(?:"), F.array_join(F.reverse(F.array_sort(F.array_distinct(finds))), "|"), F.lit(r")(?![\p{L}\p{N}_])"))
            put = lambda name: F.get(own, F.array_position(finds, name).cast("int") - 1)["put"]
            return _let(pattern, lambda p: F.transform(parts, lambda x: _woven(F.split(x, p, -1), F.transform(F.regexp_extract_all(x, p, F.lit(0)), put))))

        return _woven(_let(people, lambda own: F.when(F.size(own) > 0, bare(own)).otherwise(parts)), new)

    return F.when(F.size(FOUND) > 0, _let(F.split(text, ANY, -1), all_parts)).otherwise(text)


def replace(docs: DataFrame, key: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with surrogates in ``text``, ``n_entities long`` and ``entities array<string>`` (the kinds found, in order).

    ``key``: the secret that surrogates depend on; that of the session's ``spark.foliate.surrogate.key`` if it isn't given.
    """
    key = key or docs.sparkSession.conf.get("spark.foliate.surrogate.key", "")
    keyed = Keyed(key or DEMONSTRATION_KEY)
    clashing = {c: f"__pii_other_{k}" for k, c in enumerate(docs.columns) if c.lower() in _OWN}
    if clashing:  # such columns have another name meanwhile
        back = {new: old for old, new in clashing.items()}
        return replace(docs.withColumnsRenamed(clashing), key, broadcast_rows).withColumnsRenamed(back)
    columns = [c for c in docs.columns if c not in ("n_entities", "entities")]
    other = common.store(exceptions(docs, keyed), "pii_exceptions")
    held = found(docs.select(*columns))
    kinds = [F.size(FOUND).cast("long").alias("n_entities"), F.transform(FOUND, lambda e: e["kind"]).alias("entities")]
    others = [c for c in columns if c != "text"]
    held = surrogates(held, FOUND, FIRST, keyed)
    if not other.isEmpty():
        few = other.limit(broadcast_rows + 1).count() <= broadcast_rows
        row = F.xxhash64("text").alias(ROW), F.sha1(F.col("text")).alias(SHA)
        mentions = found(docs.select(*columns)).filter(F.size(FOUND) > 0).select(*row, F.explode(FOUND).alias("e")).select(ROW, SHA, "e.kind", "e.own").distinct()
        # Only texts with such an entity have a row here, and only those entities are in it.
        marked = mentions.join(F.broadcast(other) if few else other, ["kind", "own"])
        lists = common.store(marked.groupBy(ROW, SHA).agg(F.array_sort(F.collect_list(F.struct("kind", "own", "made"))).alias(NEW)), "pii_lists")
        short = lists.limit(broadcast_rows + 1).count() <= broadcast_rows and (lists.agg(F.sum(F.size(NEW))).first()[0] or 0) <= broadcast_rows
        held = held.withColumns({ROW: row[0], SHA: row[1]}).join(F.broadcast(lists) if short else lists, [ROW, SHA], "left")
        looked_up = lambda e: F.get(F.filter(NEW, lambda x: (x["kind"] == e["kind"]) & (x["own"] == e["own"])), F.lit(0))["made"]
        held = held.withColumn(FIRST, F.when(F.col(NEW).isNull(), F.col(FIRST)).otherwise(F.transform(FOUND, lambda e, i: F.coalesce(looked_up(e), F.get(F.col(FIRST), i)))))
    held = held.withColumn(FIRST, F.transform(FOUND, lambda e, i: _let(F.get(F.col(FIRST), i), lambda m: render(e["kind"], e["match"], m))))
    return held.select(*others, _rewritten(F.col("text"), F.col(FIRST)).alias("text"), *kinds).select(*columns, "n_entities", "entities")


#: Where neither a call nor the session has a key: surrogates that anyone can make again, for tests and demonstrations.
DEMONSTRATION_KEY = "a key for demonstrations"
