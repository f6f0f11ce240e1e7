"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Found and validated: e-mail addresses (mailbox up to 64 characters, labels of the domain up to 63, at most 126 of them), IPv4 addresses
(octets up to 255), dates (real ones of 1900-2099 as yyyy-mm-dd, dd/mm/yyyy or, where that is no date, mm/dd/yyyy),
social security numbers (ddd-dd-dddd; area neither 000, 666 nor from 900 on, no other part all zeros), phone numbers
(ten digits in the usual groupings, with or without country code; neither area nor exchange 000) and payment cards (13
to 19 digits, plain, in fours or as 4-6-5 or 4-6-4, right check digit).

Each value goes through a keyed Feistel network over its own format: the digits of a number, the days of the date
range, the 32 bits of an address, the letters and digits of a mailbox. A network is a permutation of the valid values of
a format, so equal values get equal pseudonyms in all documents, different ones stay different, and the holder of the
key can undo it (`original`). As in any permutation a value may be its own pseudonym, by chance. Cards keep a right
check digit, country codes and mail domains stay, separators stay where they are. A letter of a mailbox stays within its
script (CLASSES); one of no listed range moves among the 32 code points around it. Every pattern takes time in
proportion to the text and a stack of bounded depth.

The key is an argument: whoever has it can undo the pseudonyms, so it belongs into a secret store. The queries take it
from spark.tessella.pii.key; without it one is drawn for the application, unless the master is local (`key_of`). Left as they
are: mailboxes of more than 64 characters, account numbers (IBAN), ten digits in one run, and dates written with other
separators or month names.

A null text stays null, an empty one empty, with no finds. Rows are independent; an empty table gives an empty
result. Only text is read; all columns stay, whatever their names, and the new column gets a fresh one (common.fresh).
"""

from __future__ import annotations

import secrets
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
#: The setting that holds the key of the queries, and what tests use without it.
KEY, TEST_KEY = "spark.tessella.pii.key", "for tests"
#: First day, and number of days of the date range as a product; how many of them lie after the twelfth of a month, and
#: a product just above that.
FIRST_DAY, DAYS, LATE, WALKED = "1900-01-01", (17, 4297), 44249, (210, 211)

#: Patterns of the kinds, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[/-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}"
    + "".join(rf"|[0-9]{{4}}(?:{c}[0-9]{{4}}){{3}}{c}[0-9]{{1,3}}(?![0-9A-Za-z])|[0-9]{{4}}(?:{c}[0-9]{{4}}){{2}}{c}[0-9]{{1,4}}|[0-9]{{4}}{c}[0-9]{{6}}{c}[0-9]{{4,5}}" for c in " -")
    + ")(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
#: Without one of these a text holds none of the kinds.
HINT = r"@|[0-9][0-9./ ()-]{6}"
#: Ranges of code points that are permuted within themselves in a mailbox: first and number. Latin letters and digits,
#: Latin with marks, Greek, Cyrillic, Armenian, Hebrew, Arabic, Devanagari, Thai, Georgian, kana, Han, Hangul.
CLASSES = (
    (0x61, 26), (0x41, 26), (0x30, 10), (0xE0, 23), (0xC0, 23), (0x100, 128), (0x3B1, 25), (0x391, 17), (0x3A3, 9), (0x3AC, 4), (0x3CA, 5), (0x430, 32), (0x410, 32), (0x450, 16), (0x400, 16), (0x561, 38), (0x531, 38), (0x5D0, 27), (0x621, 26), (0x641, 10), (0x904, 54),
    (0xE01, 48), (0x10D0, 43), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172),
)


def _keyed(key: str, *parts: Column) -> Column:
    """A number below 2^52 that depends on the key and all parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def feistel(high: Column, low: Column, a: Column, b: Column, key: str, kind: str, undo: bool = False) -> Column:
    """A keyed permutation of the numbers high * b + low (high < a, low < b), or its inverse: each half in turn is
    shifted by a function of the other."""
    start = F.struct(high.cast("long").alias("l"), low.cast("long").alias("r"))
    sign = -1 if undo else 1

    def turn(acc: Column, i: Column) -> Column:
        left = F.pmod(acc["l"] + sign * _keyed(key, F.lit(kind), i, acc["r"]), a)
        right = F.pmod(acc["r"] + sign * _keyed(key, F.lit(kind), i, acc["l"]), b)
        odd = i % 2 == 1
        return F.struct(F.when(odd, left).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(right).alias("r"))

    return F.aggregate(_rounds(undo), start, turn, lambda acc: acc["l"] * b + acc["r"])


def _rounds(undo: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _number(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """A string of up to 18 digits, permuted among those of its length."""
    k = F.length(digits)
    half = F.floor(k / 2).cast("int")
    power = lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")
    high, low = F.substr(digits, F.lit(1), k - half), F.substr(digits, k - half + 1, half)
    return F.lpad(feistel(high, low, power(k - half), power(half), key, kind, undo).cast("string"), k, F.lit("0"))


def _refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substr(digits, acc["k"], F.lit(1))).alias("out"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k")))
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten in valid numbers."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x)


def _card(m: Column, key: str, undo: bool) -> Column:
    payload = _number(F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 1), key, "card", undo)
    # the check digit is that which makes the sum of payload and a zero full
    return _once(payload, lambda p: _refilled(m, F.concat(p, F.pmod(-_luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string"))))


def _part(digits: Column, at: Column | int, n: int) -> Column:
    return F.substr(digits, F.lit(at) if isinstance(at, int) else at, F.lit(n)).cast("long")


def _phone(m: Column, key: str, undo: bool) -> Column:
    """Area and exchange run from 001 to 999, the line from 0000 to 9999."""
    digits = _digits(m)
    begin = F.length(digits) - 9
    a, b = F.lit(999), F.lit(999 * 10_000)
    n = feistel(_part(digits, begin, 3) - 1, (_part(digits, begin + 3, 3) - 1) * 10_000 + _part(digits, begin + 6, 4), a, b, key, "phone", undo)
    area, rest = lambda x: F.floor(x / b) + 1, lambda x: F.pmod(x, b) + 10_000
    new = _once(n, lambda x: F.concat(F.lpad(area(x).cast("string"), 3, "0"), F.lpad(rest(x).cast("string"), 7, "0")))
    return _refilled(m, F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), new))


def _ssn(m: Column, key: str, undo: bool) -> Column:
    """898 areas, 99 groups, 9999 serials."""
    digits = _digits(m)
    area = _part(digits, 1, 3)
    a, b = F.lit(898), F.lit(99 * 9999)
    n = feistel(area - F.when(area > 666, 2).otherwise(1), (_part(digits, 4, 2) - 1) * 9999 + _part(digits, 6, 4) - 1, a, b, key, "ssn", undo)

    def said(x: Column) -> Column:
        high, low = F.floor(x / b) + 1, F.pmod(x, b)
        parts = ((high + F.when(high >= 666, 1).otherwise(0), 3), (F.floor(low / 9999) + 1, 2), (F.pmod(low, F.lit(9999)) + 1, 4))
        return F.concat(*(F.lpad(p.cast("string"), n, "0") for p, n in parts))

    return _refilled(m, _once(n, said))


def _ip(m: Column, key: str, undo: bool) -> Column:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    word = F.lit(1 << 16)
    n = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), word, word, key, "ip", undo)
    return _once(n, lambda x: F.concat_ws(".", *(F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))


def _day(m: Column) -> Column:
    """Days since the first one, null if this is no date; only dates that are written as they were read."""
    dates = (F.try_to_date(m, form) for form in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy"))
    return F.datediff(F.coalesce(*dates), F.to_date(F.lit(FIRST_DAY)))


def _date(m: Column, key: str, undo: bool) -> Column:
    first = F.to_date(F.lit(FIRST_DAY))

    def permuted(n: Column, sizes: tuple[int, int], kind: str) -> Column:
        a, b = map(F.lit, sizes)
        return feistel(F.floor(n / b), F.pmod(n, b), a, b, key, kind, undo).cast("int")

    def month_first(day: Column) -> Column:
        """Dates that only this order can mean are permuted among themselves: those after the twelfth, counted."""
        date = F.date_add(first, day)
        months = (F.year(date) - 1900) * 12 + F.month(date)
        # the 61 numbers too many are walked past; that eight steps do not suffice has a chance below 1e-22
        step = lambda n, i: F.when((i == 1) | (n >= LATE), permuted(n, WALKED, "late")).otherwise(n)

        def written(new: Column) -> Column:
            guess = F.floor(new * 2400 / LATE).cast("int")
            start = lambda k: F.datediff(F.add_months(first, k), first) - 12 * k
            near = F.filter(F.sequence(guess - 3, guess + 3), lambda k: (start(k) <= new) & (new < start(k + 1)))
            return F.date_format(F.date_add(first, new + 12 * (F.get(near, F.lit(0)) + 1)), "MM/dd/yyyy")

        return _once(F.aggregate(F.sequence(F.lit(1), F.lit(8)), (day - 12 * months).cast("int"), step), written)

    def said(day: Column) -> Column:
        new = lambda: F.date_add(first, permuted(day, DAYS, "date"))
        day_first = F.try_to_date(m, "dd/MM/yyyy").isNotNull()
        return F.when(~m.contains("/"), F.date_format(new(), "yyyy-MM-dd")).when(day_first, F.date_format(new(), "dd/MM/yyyy")).otherwise(month_first(day))

    return _once(_day(m), said)


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _shifted(half: Column, other: Column, i: Column, key: str, undo: bool) -> Column:
    """Every letter and digit of one half moved within its class by a function of the other half and the place."""

    def move(c: Column, k: Column, other: Column) -> Column:
        code = F.ascii(c).cast("long")
        by = _keyed(key, F.lit("email"), i, k, other) * (-1 if undo else 1)
        block = code - F.pmod(code, F.lit(32))
        out = F.when(code < 0x80, c).otherwise(_character(block + F.pmod(code - block + by, F.lit(32))))
        return reduce(lambda out, x: F.when((code >= x[0]) & (code < x[0] + x[1]), _character(x[0] + F.pmod(code - x[0] + by, F.lit(x[1])))).otherwise(out), CLASSES[::-1], out)

    digest = F.sha2(F.concat_ws("|", F.length(half).cast("string"), other), 256)
    return _once(digest, lambda d: F.array_join(F.transform(F.split(half, ""), lambda c, k: move(c, k, d)), ""))


def _email(m: Column, key: str, undo: bool) -> Column:
    box = F.substring_index(m, "@", 1)
    half = F.floor(F.length(box) / 2).cast("int")
    start = F.struct(F.substr(box, F.lit(1), half).alias("l"), F.substr(box, half + 1, F.length(box)).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, _shifted(acc["l"], acc["r"], i, key, undo)).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(_shifted(acc["r"], acc["l"], i, key, undo)).alias("r"))

    new = F.aggregate(_rounds(undo), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))
    return F.concat(new, F.substr(m, F.length(box) + 1, F.length(m)))


def _whole(m: Column, kind: str) -> Column:
    return m.rlike("^(?:" + PATTERNS[kind] + ")$")


def _replaced(m: Column, key: str, undo: bool) -> Column:
    """kind (null if not valid) and new for one find."""
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    digits = _digits(m)
    area, ten = F.substr(digits, F.lit(1), F.lit(3)), F.right(digits, F.lit(10))
    social = ~area.isin("000", "666") & (area < "900") & (F.substr(digits, F.lit(4), F.lit(2)) != "00") & (F.right(digits, F.lit(4)) != "0000")
    valid = {
        "email": (m.contains("@"), F.lit(True), _email(m, key, undo)),
        "ip": (_whole(m, "ip"), octets, _ip(m, key, undo)),
        "date": (_whole(m, "date"), F.coalesce((_day(m) >= 0) & (_day(m) < DAYS[0] * DAYS[1]), F.lit(False)), _date(m, key, undo)),
        "ssn": (_whole(m, "ssn"), social, _ssn(m, key, undo)),
        "phone": (_whole(m, "phone"), (F.substr(ten, F.lit(1), F.lit(3)) != "000") & (F.substr(ten, F.lit(4), F.lit(3)) != "000"), _phone(m, key, undo)),
        "card": (_whole(m, "card"), _luhn(digits) % 10 == 0, _card(m, key, undo)),
    }
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"))
    for kind, (looks, holds, new) in reversed(valid.items()):
        found = F.when(holds, F.struct(F.lit(kind).alias("kind"), new.alias("new"))).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))
        out = F.when(looks, found).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """docs with text replaced and one more column, `pii_kinds` (or a fresh name): the kinds of what was replaced, in
    order of place. undo: pseudonyms back to values."""
    kinds, gaps, new, finds = (common.fresh(docs, x) for x in ("pii_kinds", "pii_gaps", "pii_new", "pii_finds"))
    hint = F.col("text").rlike(HINT)
    none = F.array().cast("array<string>")
    found = docs.withColumn(finds, F.when(hint, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none))
    some = F.size(finds) > 0
    found = found.withColumns({gaps: F.when(some, F.split("text", ANY, -1)), new: F.when(some, F.transform(finds, lambda m: _replaced(m, key, undo)))})
    pieces = F.zip_with(gaps, F.col(new)["new"], lambda g, x: F.concat(g, F.coalesce(x, F.lit(""))))
    text = F.when(F.col(gaps).isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text"))
    found = found.withColumns({"text": text, kinds: F.coalesce(F.filter(F.col(new)["kind"], lambda k: k.isNotNull()), none)})
    return found.drop(finds, gaps, new)


def original(docs: DataFrame, key: str) -> DataFrame:
    """The texts before pseudonymise() with the same key, for values that it counted."""
    return pseudonymise(docs, key, undo=True)


#: Application to the key that was drawn for it.
_DRAWN: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key in spark.tessella.pii.key. Without it a local master, as in tests, takes TEST_KEY. On a cluster, where
    pseudonyms by a public key could be undone by anybody, 256 random bits are drawn, the same for all queries of the
    application. They are kept nowhere: only who asks for them here while it runs can undo its pseudonyms later, and another
    application gives other ones."""
    key = spark.conf.get(KEY, None)
    if key:
        return key
    if spark.sparkContext.master.startswith("local"):
        return TEST_KEY
    warnings.warn(f"{KEY} is not set: the pseudonyms take a key drawn for this application alone", stacklevel=2)
    return _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(common.documents(spark, sf_dir).select("doc_id", "text"), key_of(spark))
    count = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", "text", *map(count, PATTERNS))
