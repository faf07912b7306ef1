"""Format-preserving pseudonyms by a keyed Feistel permutation, in DataFrame functions alone (operator 2).

Found and validated:

- payment card numbers: 13 to 19 digits, single blanks or hyphens between them, Luhn check right; within
  a run of more digits only unbroken ones and the groups 4-4-4-4, 4-4-4-4-3, 4-6-4 and 4-6-5
- telephone numbers: ``+1 (NNN) NNN-NNNN`` and the like, with a country code or an area code; with
  blanks alone only where area and exchange may exist and no other digits stand beside
- social security numbers ``NNN-NN-NNNN`` whose three parts may exist
- IPv4 addresses: four numbers of at most 255; IPv6 addresses, whole or shortened by ``::``
- bank account numbers (IBAN), unbroken or in groups of four, with right check digits
- dates: ``YYYY-MM-DD``, ``YYYY/MM/DD``, ``DD.MM.YYYY``, ``DD/MM/YYYY``, ``MM/DD/YYYY``, of the
  years 1700 to 2099, that exist
- e-mail addresses: letters and digits of the local part
- secrets: access keys of a known form, and values of 12 or more letters and digits after ``token``,
  ``password``, ``secret`` or ``key`` and an equals sign or colon

Each kind is permuted within its own format by eight Feistel rounds keyed through SHA-256, so
equal values get equal pseudonyms in all documents, different values different ones, and the
layout (blanks, hyphens, brackets, letter case) stays. A card keeps its length and a right check
digit. A date is a number of days in the 400-year cycle of the calendar, 146,097 = 189 x 773
days, whose two factors are the halves; an address has two halves of 65,536 values. Strings are
halved by length and each character moves within its class (0-9, a-z, A-Z); the rest stay. A
secret of hexadecimal digits, letters and numbers both among them, moves within those: it and all other secrets
are permuted on until they are of their own kind again, or two could get one pseudonym. The check digits of
a bank account follow from its new characters; the digits of an IPv6 address move in their places.
Ambiguous ``D/M`` dates are read day first; those that only exist month first get pseudonyms that
only exist month first. As in any permutation a value may map to itself.

The key reaches the plan as the result of a subquery: neither explained plans nor event logs show it.

Defined results: a null text stays null; text without such values is returned as it is, byte for
byte, as an empty one is; values and texts of any length are replaced whole; where two kinds could
start at one place the first of ``PATTERN`` holds; repeated rows are treated alike; rows, order of
columns and all other columns, whatever their names, are left alone; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

ROUNDS = 8
LONG = 600
EPOCH, DAYS, LEFT, RIGHT = "1700-01-01", 146097, 189, 773
#: Steps at most to a month-first date with a day above 12; two of five are not, so none is left after these.
WALK = 64

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"
DATE = r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d\-/])"
IPV4 = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
PHONE = (
    r"(?<![\d+])\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)"
    r"|(?<![\d+])\+(?!1[ (.\-])\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)"
)
SPACED = r"(?<![\d+)])(?<!\d[ \-])[2-9]\d{2} [2-9]\d{2} \d{4}(?![ \-]?\d)"
SSN = r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}"
    rf"|(?=(?:[0-9A-Fa-f]{{0,4}}:){{3}}|[0-9A-Fa-f]{{3,4}}::{_GROUP})(?=(?:[0-9A-Fa-f]*:){{2,7}}+[0-9A-Fa-f]*(?!:))(?:{_GROUP}(?::{_GROUP}){{0,5}}+)?::(?:{_GROUP}(?::{_GROUP}){{0,5}}+)?)(?![0-9A-Za-z:])"
)
#: What may begin after a blank or hyphen within a run of digits, and ends the run there.
_OTHER = "|".join(f"(?:{p})" for p in (EMAIL, DATE, IPV4, IPV6, PHONE, SSN))
#: A whole run of 13 digits or more, not the fraction of a decimal number; ``_card`` finds the cards in it.
CARD = rf"(?<!\d)(?<!\d\.)\d(?:(?:[ \-](?!{_OTHER}))?\d){{12,}}+"
#: Usual groups of a card: the only ones looked for in a run of more than 19 digits.
GROUPS = "^(?:\\d{13,19}|\\d{4}(?: \\d{4}){3}(?: \\d{3})?|\\d{4} \\d{6} \\d{4,5})$"
SECRET = (
    r"(?=[AKPSTakpst])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|(?i:token|passw(?:or)?d|secret|api_?key|key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9_\-+/]{12,}+)"
)
#: In order of precedence where two could start at the same place.
PATTERN = f"(?:{EMAIL})|(?:{SECRET})|(?:{IBAN})|(?=[0-9A-Fa-f:])(?:{IPV6})|(?=[\\d+(])(?:" + "|".join(f"(?:{p})" for p in (DATE, IPV4, SSN, PHONE, SPACED, CARD)) + ")"
#: Every match has one of these; a text without any is not searched further.
NEEDED = "[0-9@=:]|AKIA|ASIA"



def _number(key: str | Column, kind: Column | str, turn: Column, half: Column) -> Column:
    """The round function: 60 bits of SHA-256 over key, kind, round and the other half."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _rounds() -> Column:
    return F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def permute_pair(left: Column, right: Column, left_size: int, right_size: int, key: str | Column, kind: str) -> Column:
    """A permutation of the pairs (left, right) below the two sizes: a struct of l and r."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + _number(key, kind, i, s["r"]), F.lit(left_size))).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _number(key, kind, i, s["l"]), F.lit(right_size))).alias("r"),
        )

    return F.aggregate(_rounds(), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def permute_text(text: Column, key: str | Column, kind: Column | str) -> Column:
    """A permutation of the strings of one format: each character moves within its class."""
    return F.transform(F.array(text), lambda x: _permuted(x, F.lit(False), key, kind))[0]


def _mixed_hexadecimal(text: Column) -> Column:
    return text.rlike("^[0-9a-f]+$") & text.rlike("[a-f]") & text.rlike("[0-9]")


def permute_secret(text: Column, key: str | Column) -> Column:
    """The same, in which mixed hexadecimal strings are a format of their own: both kinds go on until they are of their kind again."""
    given = F.array(F.struct(text.alias("text"), _mixed_hexadecimal(text).alias("hex")))

    def walk(x: Column) -> Column:
        def step(t: Column, _: Column) -> Column:
            return F.when(_mixed_hexadecimal(t) != x["hex"], _permuted(t, x["hex"], key, "secret")).otherwise(t)

        # a step leaves the kind with a chance of a quarter at most, so none is left after these
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x["text"], step)

    once = F.transform(given, lambda x: F.struct(_permuted(x["text"], x["hex"], key, "secret").alias("text"), x["hex"].alias("hex")))
    return F.transform(once, walk)[0]


def permute_hexadecimal(text: Column, key: str | Column, kind: Column | str) -> Column:
    """A permutation of the strings of 0-9 and a-f of one length."""
    return F.transform(F.array(text), lambda x: _permuted(x, F.lit(True), key, kind))[0]


def _permuted(text: Column, hexadecimal: Column, key: str | Column, kind: Column | str) -> Column:
    n = F.length(text)

    def move(target: Column, other: Column, i: Column) -> Column:
        prefix = F.concat_ws("|", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, n.cast("string"), i.cast("string"), other)

        # a long half goes into each digest as its own digest, or time would grow with its square
        start = F.array(F.when(n > LONG, F.sha2(prefix, 256)).otherwise(prefix))

        def one(c: Column, k: Column, begin: Column) -> Column:
            # 32 places share a digest, 4 hexadecimal digits each
            digest = F.sha2(F.concat_ws("|", begin, F.floor(k / 16).cast("string")), 256)
            step = F.conv(F.substring(digest, (k % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            shifted = (
                F.when(hexadecimal, F.ascii(F.lower(F.conv(F.pmod(F.conv(c, 16, 10).cast("int") + step, F.lit(16)).cast("string"), 10, 16))))
                .when(c.rlike("^[0-9]$"), F.pmod(code - 48 + step, F.lit(10)) + 48)
                .when(c.rlike("^[a-z]$"), F.pmod(code - 97 + step, F.lit(26)) + 97)
                .when(c.rlike("^[A-Z]$"), F.pmod(code - 65 + step, F.lit(26)) + 65)
            )
            return F.coalesce(F.char(shifted), c)

        return F.when(F.length(target) == 0, target).otherwise(F.transform(start, lambda b: F.array_join(F.transform(F.split(target, ""), lambda c, k: one(c, k, b)), ""))[0])

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, move(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(move(s["r"], s["l"], i)).alias("r"),
        )

    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, n).alias("r"))
    return F.aggregate(_rounds(), start, turn, lambda s: F.concat(s["l"], s["r"]))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def into_layout(layout: Column, chars: Column, kind: str = "0-9") -> Column:
    """The characters of a kind in ``layout``, digits if not named, replaced in order by ``chars``."""
    before = lambda i: F.length(F.regexp_replace(F.substring(layout, F.lit(1), i + 1), f"[^{kind}]", ""))
    return F.array_join(F.transform(F.split(layout, ""), lambda c, i: F.when(c.rlike(f"^[{kind}]$"), F.substring(chars, before(i), F.lit(1))).otherwise(c)), "")


def luhn_sum(number: Column, doubled: int) -> Column:
    """The Luhn sum of a string of digits; ``doubled`` is 1 if its last digit counts twice."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * F.when((i + doubled) % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add)


def _one_card(m: Column, key: str | Column) -> Column:
    d = digits(m)
    body = F.array(permute_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"))
    return F.transform(body, lambda b: into_layout(m, F.concat(b, F.pmod(-luhn_sum(b, 1), F.lit(10)).cast("string"))))[0]


def _card(m: Column, key: str | Column) -> Column:
    """A run of digits with the cards in it replaced: groups from the left, of usual lengths if there are any such cards.

    In a run of at most 19 digits any groups of 13 digits or more with a right check digit are a card.
    """
    return F.transform(F.array(F.split(m, "[ -]")), lambda groups: _cards_of(m, groups, key))[0]


def _cards_of(m: Column, groups: Column, key: str | Column) -> Column:
    n = F.length(F.array_join(groups, ""))

    def ends(i: Column, usual: bool) -> Column:
        """The last groups, the longest first, of the cards that start at group i."""

        def is_card(j: Column) -> Column:
            cut = F.slice(groups, i + 1, j - i + 1)
            text = F.array_join(cut, "")
            known = F.array_join(cut, " ").rlike(GROUPS) if usual else F.length(text).between(13, 19)
            return known & (luhn_sum(text, 0) % 10 == 0) & ~text.rlike("^0+$")

        return F.reverse(F.filter(F.sequence(i, F.least(i + 18, F.size(groups) - 1)), is_card))

    def spans(usual: bool) -> Column:
        """start and end groups of cards that do not overlap."""
        firsts = F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.struct(i.alias("i"), F.get(ends(i, usual), F.lit(0)).alias("j")))
        nothing = F.array().cast("array<struct<i:int,j:int>>")
        free = lambda done, x: F.coalesce(F.get(done, F.size(done) - 1)["j"] < x["i"], F.lit(True))
        return F.aggregate(F.filter(firsts, lambda x: x["j"].isNotNull()), nothing, lambda done, x: F.when(free(done, x), F.array_append(done, x)).otherwise(done))

    def place(k: Column) -> Column:
        """The place, from 1, of the first character of group k."""
        return F.when(k == 0, 1).otherwise(F.length(F.array_join(F.slice(groups, F.lit(1), k), " ")) + 2)

    def put(found: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            first, after = place(x["i"]), place(x["j"] + 1) - 1
            new = _one_card(F.substring(m, first, after - first), key)
            return F.struct(F.concat(s["out"], F.substring(m, s["at"], first - s["at"]), new).alias("out"), after.alias("at"))

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        return F.aggregate(found, start, add, lambda s: F.concat(s["out"], F.substring(m, s["at"], F.length(m))))

    usual = F.array(spans(True))
    chosen = F.transform(usual, lambda u: F.when((F.size(u) > 0) | (n > 19), u).otherwise(spans(False)))
    return F.transform(chosen, put)[0]


def _date(m: Column, key: str | Column) -> Column:
    year_first = m.rlike(r"^\d{4}")
    mark = F.when(year_first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    year = F.when(year_first, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4))
    month = F.when(year_first, F.substring(m, 6, 2)).otherwise(F.substring(m, 4, 2))
    day = F.when(year_first, F.substring(m, 9, 2)).otherwise(F.substring(m, 1, 2))
    epoch = F.lit(EPOCH).cast("date")
    there = F.concat_ws("-", year, month, day).try_cast("date")
    # with slashes, what is no date day first may be one month first; its day is above 12
    month_first = there.isNull() & ~year_first & (mark == "/")
    n = F.datediff(F.coalesce(there, F.when(month_first, F.concat_ws("-", year, day, month).try_cast("date"))), epoch).cast("long")

    def there_at(p: Column) -> Column:
        return F.date_add(epoch, (p["l"] * RIGHT + p["r"]).cast("int"))

    def turn(p: Column) -> Column:
        return permute_pair(p["l"], p["r"], LEFT, RIGHT, key, "date")

    def walk(p: Column, _: Column) -> Column:
        return F.when(month_first & (F.dayofmonth(there_at(p)) <= 12), turn(p)).otherwise(p)

    once = F.array(permute_pair(F.floor(n / RIGHT), n % RIGHT, LEFT, RIGHT, key, "date"))
    # month first: on to a date that again can only be read so, or two dates could get one pseudonym
    moved = F.transform(once, lambda p: F.aggregate(F.sequence(F.lit(1), F.when(month_first, WALK).otherwise(1)), p, walk))

    def show(p: Column) -> Column:
        y, mo, d = (F.date_format(there_at(p), x) for x in ("yyyy", "MM", "dd"))
        return F.when(year_first, F.concat(y, mark, mo, mark, d)).when(month_first, F.concat(mo, mark, d, mark, y)).otherwise(F.concat(d, mark, mo, mark, y))

    return F.when(n.between(0, DAYS - 1), F.transform(moved, show)[0]).otherwise(m)


def _address(m: Column, key: str | Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    pair = F.array(permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4"))
    whole = F.transform(pair, lambda p: F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256))))
    return whole[0]


def _email(m: Column, key: str | Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_text(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def _phone(m: Column, key: str | Column) -> Column:
    country = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .\-(]))?", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    moved = F.array(permute_text(digits(rest), key, F.concat(F.lit("phone"), country)))
    return F.transform(moved, lambda d: F.concat(country, into_layout(rest, d)))[0]


def _secret(m: Column, key: str | Column) -> Column:
    head = F.regexp_extract(m, r"^((?:AKIA|ASIA)|.*?[=:]\s*[\"']?)", 1)
    return F.concat(head, permute_secret(F.substring(m, F.length(head) + 1, F.length(m)), key))


def _social(m: Column, key: str | Column) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, number 0001 to 9999."""
    area, group, number = (F.substring(m, p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    place = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    moved = F.array(permute_pair(place, number - 1, 898 * 99, 9999, key, "ssn"))

    def show(p: Column) -> Column:
        at = F.floor(p["l"] / 99)
        parts = ((at + F.when(at >= 665, 2).otherwise(1), 3), (p["l"] % 99 + 1, 2), (p["r"] + 1, 4))
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in parts))

    return F.transform(moved, show)[0]


def _ipv6(m: Column, key: str | Column) -> Column:
    low = F.lower(m)
    bare = F.replace(low, F.lit(":"), F.lit(""))
    moved = F.array(permute_hexadecimal(bare, key, "ipv6"))
    shown = F.transform(moved, lambda h: into_layout(low, h, "0-9a-f"))[0]
    return F.when(m.rlike("[A-F]"), F.upper(shown)).otherwise(shown)


def mod_97(text: Column) -> Column:
    """The number that stands for digits and capital letters (A is 10), modulo 97."""

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _account(m: Column, key: str | Column) -> Column:
    """The account number, or what of it is left without a last group that belongs to the words behind."""
    shorter = F.regexp_replace(m, " [A-Z0-9]+$", "")

    def valid(x: Column) -> Column:
        bare = F.replace(x, F.lit(" "), F.lit(""))
        return F.length(bare).between(15, 34) & (mod_97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)

    def moved(x: Column) -> Column:
        bare, country = F.replace(x, F.lit(" "), F.lit("")), F.substring(x, 1, 2)
        body = F.array(permute_text(F.substring(bare, F.lit(5), F.length(bare)), key, F.concat(F.lit("iban"), country)))

        def show(b: Column) -> Column:
            check = F.lpad((98 - mod_97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            return into_layout(x, F.concat(country, check, b), "0-9A-Z")

        return F.transform(body, show)[0]

    return F.when(valid(m), moved(m)).when(valid(shorter), F.concat(moved(shorter), F.substring(m, F.length(shorter) + 1, F.length(m)))).otherwise(m)


def pseudonym(m: Column, key: str | Column) -> Column:
    """What stands for one match of PATTERN."""
    return (
        F.when(m.rlike(f"^(?:{EMAIL})$"), _email(m, key))
        .when(m.rlike(f"^(?:{SECRET})$"), _secret(m, key))
        .when(m.rlike(f"^(?:{IBAN})$"), _account(m, key))
        .when(m.rlike(f"^(?:{IPV6})$"), _ipv6(m, key))
        .when(m.rlike(f"^(?:{DATE})$"), _date(m, key))
        .when(m.rlike(f"^(?:{IPV4})$"), _address(m, key))
        .when(m.rlike(f"^(?:{SSN})$"), _social(m, key))
        .when(m.rlike(f"^(?:{PHONE}|{SPACED})$"), _phone(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with the values in ``text`` replaced; ``found`` names a column for how many values changed.

    ``key`` is the secret of the permutation and has to be the same for all data that should stay linked.
    """
    if not key:
        raise ValueError("a key is needed")
    spark, t = docs.sparkSession, F.col(f"`{text}`")
    name, secret = unused("_pseudonymised", docs.columns), unused("_key", docs.columns)
    held, key = spark.createDataFrame([(key,)], "k string").scalar(), F.col(f"`{secret}`")
    matches = F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    gaps = F.split(t, PATTERN, -1)

    # one match and the gap before it at a time; what does not match is copied as it is
    def replaced(ms: Column) -> Column:
        return F.transform(ms, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))

    def rebuilt(done: Column) -> Column:
        pieces = F.zip_with(gaps, done, lambda g, p: F.concat(g, F.coalesce(p["new"], F.lit(""))))
        return F.struct(F.array_join(pieces, "").alias("text"), F.size(F.filter(done, lambda p: p["old"] != p["new"])).cast("long").alias("n"))

    whole = F.transform(F.array(replaced(matches)), rebuilt)[0]
    # most texts have nothing to replace: one search tells, and they are passed on as they are
    out = F.when(t.rlike(NEEDED) & t.rlike(PATTERN), whole).when(t.isNotNull(), F.struct(t.alias("text"), F.lit(0).cast("long").alias("n")))
    rows = docs.withColumn(secret, held).withColumn(name, out)
    put = [F.col(f"`{name}`.text").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != found]
    if found:
        put.append(F.coalesce(F.col(f"`{name}`.n"), F.lit(0).cast("long")).alias(found))
    return rows.select(*put)
