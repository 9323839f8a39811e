"""PII: format-preserving pseudonyms by keyed Feistel permutations, in DataFrame expressions only.

Numbers and dates are found by their format and validated (checksum, ranges, calendar); each valid one is permuted among the valid
values of its own format, so a pseudonym looks and validates as the value did, equal values get equal pseudonyms in all documents,
and different ones stay different. The key holder can invert it; without the key the value isn't in the text any more.

A value is a pair of digits strings or numbers (left, right); a round adds a keyed hash of one half to the other, modulo the
size of that half, and ten rounds make the permutation. Nothing is looked up or shuffled: a text is cut at its candidates and put
together again inside its own row.

Kinds, and what stays: card numbers (13 to 19 digits with a right Luhn digit, which is made right again); IBANs (country and
groups stay, check digits are made right again); US social security numbers (area, group and serial in the issued ranges); phone
numbers of the forms +C (AAA) BBB-DDDD and +C with 7 to 14 digits (country code and punctuation stay); IPv4 addresses; dates
from 1900 to 2099 as Y-M-D, Y/M/D, D.M.Y and M/D/Y (read as D/M/Y if the
first number can be no month; written with the month first); numbers in the local part of an
e-mail address, which is permuted as a whole over letters and digits; hexadecimal secrets of 32 digits or more.

Defined results: a null text stays null, an empty one empty; a text without valid candidates is returned as it was. Whatever a
candidate's format finds but doesn't validate is left alone. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10

# The formats of candidates, in the order they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
HEX = r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?: \([0-9]{3}\) [0-9]{3}-[0-9]{4}|(?:[ .-]?[0-9]{2,4}){3,5})(?![0-9])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
CANDIDATE = "|".join((EMAIL, HEX, IBAN, PHONE, IP, SSN, DATE, CARD))

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _hash(key: str, kind: str, step: Column, half: Column, size: Column) -> Column:
    """A keyed number below ``size`` (at most 10**12) from one half."""
    mixed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string"), F.lit(key)).cast("binary"), 256)
    return F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long") % size


def feistel(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column, inverse: bool = False) -> Column:
    """A struct (left, right): the pair permuted among all pairs below the two sizes (each at most 10**12)."""
    steps = range(ROUNDS)

    def change(pair: Column, step: Column) -> Column:
        sign = -1 if inverse else 1
        on_left = F.pmod(pair["left"] + sign * _hash(key, kind, step, pair["right"], left_size), left_size)
        on_right = F.pmod(pair["right"] + sign * _hash(key, kind, step, pair["left"], right_size), right_size)
        even = step % 2 == 0
        return F.struct(F.when(even, on_left).otherwise(pair["left"]).alias("left"), F.when(even, pair["right"]).otherwise(on_right).alias("right"))

    order = list(reversed(steps)) if inverse else list(steps)
    begin = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.array(*[F.lit(k) for k in order]), begin, change)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k) for k in range(13)]), n + 1)


def _permuted_digits(key: str, kind: str, digits: Column, inverse: bool) -> Column:
    """A string of 2 to 24 digits permuted among all of its length."""
    low = (F.length(digits) / 2).cast("int")
    high = F.length(digits) - low
    pair = feistel(key, kind, F.substring(digits, F.lit(1), high), F.substring(digits, high + 1, low), _power(high), _power(low), inverse)
    return F.concat(F.lpad(pair["left"].cast("string"), high, "0"), F.lpad(pair["right"].cast("string"), low, "0"))


def _each(text: Column) -> Column:
    return F.split(text, "")


def _luhn(payload: Column) -> Column:
    """The check digit of a string of digits."""
    doubled = F.transform(F.reverse(_each(payload)), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return (F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))).cast("string")


def _refilled(shape: Column, chars: Column, of: str) -> Column:
    """``shape`` with its characters of the class ``of`` replaced by ``chars`` in turn."""
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(done: Column, c: Column) -> Column:
        own = c.rlike(of)
        return F.struct(
            F.concat(done["out"], F.when(own, F.substring(chars, done["next"], F.lit(1))).otherwise(c)).alias("out"),
            (done["next"] + own.cast("int")).alias("next"),
        )

    return F.aggregate(_each(shape), begin, step, lambda done: done["out"])


def _alphabet_permuted(key: str, kind: str, text: Column, alphabets: tuple[str, ...], inverse: bool) -> Column:
    """Characters of the alphabets shifted inside their own alphabet by keyed hashes of all characters before or after them.

    An unbalanced Feistel network over two halves of the text: each round shifts one half by a hash of the other, so any text is a
    value of its own format: letters stay letters of their case, digits stay digits, others stay.
    """
    half = (F.length(text) / 2).cast("int")

    def shifted(part: Column, by: Column, step: Column, sign: int) -> Column:
        def one(c: Column, i: Column) -> Column:
            out = c
            for alphabet in alphabets:
                move = _hash(key, kind, F.concat_ws(".", step.cast("string"), i.cast("string")), by, F.lit(len(alphabet)))
                at = F.pmod(F.instr(F.lit(alphabet), c) - 1 + sign * move, F.lit(len(alphabet)))
                out = F.when(F.instr(F.lit(alphabet), c) > 0, F.substring(F.lit(alphabet), at.cast("int") + 1, F.lit(1))).otherwise(out)
            return out

        return F.when(F.length(part) > 0, F.array_join(F.transform(_each(part), one), "")).otherwise(part)

    def change(pair: Column, step: Column) -> Column:
        sign = -1 if inverse else 1
        even = step % 2 == 0
        left = F.when(even, shifted(pair["left"], pair["right"], step, sign)).otherwise(pair["left"])
        right = F.when(even, pair["right"]).otherwise(shifted(pair["right"], pair["left"], step, sign))
        return F.struct(left.alias("left"), right.alias("right"))

    steps = list(reversed(range(ROUNDS))) if inverse else list(range(ROUNDS))
    begin = F.struct(F.substring(text, F.lit(1), half).alias("left"), F.substring(text, half + 1, F.length(text)).alias("right"))
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), begin, change, lambda pair: F.concat(pair["left"], pair["right"]))


def _email(key: str, found: Column, inverse: bool) -> Column:
    local = F.substring_index(found, "@", 1)
    return F.concat(_alphabet_permuted(key, "email", local, (_LOWER, _LOWER.upper(), _DIGITS), inverse), F.substring(found, F.length(local) + 1, F.length(found)))


def _hex(key: str, found: Column, inverse: bool) -> Column:
    lower = found.rlike("[a-f]")
    own = _alphabet_permuted(key, "hex", F.lower(found), (_DIGITS + "abcdef",), inverse)
    return F.when(lower, own).otherwise(F.upper(own))


def _card(key: str, found: Column, inverse: bool) -> Column:
    digits = _digits(found)
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    valid = _luhn(payload) == F.substring(digits, F.length(digits), F.lit(1))
    own = _permuted_digits(key, "card", payload, inverse)
    return F.when(valid, _refilled(found, F.concat(own, _luhn(own)), "[0-9]"))


def _mod97(text: Column) -> Column:
    """An alphanumeric string as a number (A is 10, Z is 35), modulo 97."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(_each(text), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97)


def _iban(key: str, found: Column, inverse: bool) -> Column:
    plain = F.regexp_replace(found, " ", "")
    country, check, account = F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substring(plain, F.lit(5), F.length(plain))
    own = _alphabet_permuted(key, "iban", account, (_LOWER.upper(), _DIGITS), inverse)
    fresh = F.lpad((98 - _mod97(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(_mod97(F.concat(account, country, check)) == 1, _refilled(found, F.concat(country, fresh, own), "[0-9A-Z]"))


def _phone(key: str, found: Column, inverse: bool) -> Column:
    country = F.regexp_extract(found, r"^\+[0-9]{1,3}(?=[ .-])|^\+[0-9]", 0)
    rest = F.substring(found, F.length(country) + 1, F.length(found))
    digits = _digits(rest)
    return F.when(F.length(digits).between(7, 14), F.concat(country, _refilled(rest, _permuted_digits(key, "phone", digits, inverse), "[0-9]")))


def _ip(key: str, found: Column, inverse: bool) -> Column:
    octets = F.transform(F.split(found, r"\."), lambda o: o.cast("int"))
    valid = F.forall(octets, lambda o: o <= 255) & ~found.rlike(r"(^|\.)0[0-9]")
    at = lambda i: F.element_at(octets, i)
    # host part, last octet of the network and the one before permuted; the first octet stays, so an address stays as public as it was
    pair = feistel(key, "ip", at(2) * 16 + F.floor(at(3) / 16), (at(3) % 16) * 256 + at(4), F.lit(4096), F.lit(4096), inverse)
    left, right = pair["left"], pair["right"]
    return F.when(valid, F.concat_ws(".", at(1), F.floor(left / 16), (left % 16) * 16 + F.floor(right / 256), right % 256))


def _ssn(key: str, found: Column, inverse: bool) -> Column:
    area, group, serial = (F.element_at(F.split(found, "-"), i).cast("int") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("int")  # 898 areas are issued
    pair = feistel(key, "ssn", place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), inverse)
    fresh = F.floor(pair["left"] / 99)
    fresh_area = fresh + 1 + (fresh >= 665).cast("int")
    return F.when(valid, F.format_string("%03d-%02d-%04d", fresh_area, pair["left"] % 99 + 1, pair["right"] + 1))


def _date(key: str, found: Column, inverse: bool) -> Column:
    part = lambda i: F.element_at(F.split(found, r"[-/.]"), i)
    year_first, dotted = found.rlike("^[0-9]{4}"), found.contains(".")
    day_first = dotted | (part(1).cast("int") > 12)
    year = F.when(year_first, part(1)).otherwise(part(3))
    month = F.when(year_first, part(2)).when(day_first, part(2)).otherwise(part(1))
    day = F.when(year_first, part(3)).when(day_first, part(1)).otherwise(part(2))
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
    # 1900 to 2099 has 73,049 days, 17 times 4297
    number = F.datediff(date, F.lit("1900-01-01").cast("date"))
    pair = feistel(key, "date", F.floor(number / 4297), number % 4297, F.lit(17), F.lit(4297), inverse)
    fresh = F.date_add(F.lit("1900-01-01").cast("date"), (pair["left"] * 4297 + pair["right"]).cast("int"))
    written = F.when(year_first & found.contains("-"), F.date_format(fresh, "yyyy-MM-dd")).when(year_first, F.date_format(fresh, "yyyy/MM/dd"))
    written = written.when(dotted, F.date_format(fresh, "dd.MM.yyyy")).otherwise(F.date_format(fresh, "MM/dd/yyyy"))
    return F.when(date.between(F.lit("1900-01-01"), F.lit("2099-12-31")), written)


# Kind, the format that tells it, and the pseudonym of a candidate (null if it doesn't validate).
KINDS: list[tuple[str, str, Callable[[str, Column, bool], Column]]] = [
    ("email", EMAIL, _email),
    ("secret", HEX, _hex),
    ("iban", IBAN, _iban),
    ("phone", PHONE, _phone),
    ("ip", IP, _ip),
    ("ssn", SSN, _ssn),
    ("date", DATE, _date),
    ("card", CARD, _card),
]


def pseudonym(found: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it isn't valid."""
    out = F.lit(None).cast("string")
    for _, form, of in reversed(KINDS):
        out = F.when(found.rlike(f"^(?:{form})$"), of(key, found, inverse)).otherwise(out)
    return F.coalesce(out, found)


def pseudonymised(documents: DataFrame, key: str, text: str = "text", replaced: str | None = None, inverse: bool = False) -> DataFrame:
    """``documents`` with pseudonyms in ``text``; with ``replaced``, also how many values were (a column of that name)."""
    # every candidate has a digit or an @: texts without are spared the long pattern
    found = F.regexp_extract_all(F.col(text), F.lit(f"({CANDIDATE})"), F.lit(1))
    work = documents.withColumn("_found", F.when(F.col(text).rlike("[0-9@]"), found).otherwise(F.array().cast("array<string>")))
    none = F.size("_found") == 0
    fresh = F.when(none, F.col("_found")).otherwise(F.transform("_found", lambda f: pseudonym(f, key, inverse)))
    work = work.withColumn("_fresh", fresh)
    between = F.split(F.col(text), CANDIDATE, -1)
    joined = F.concat(F.array_join(F.zip_with(between, F.col("_fresh"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    out = work.withColumn(text, F.when(F.col(text).isNull() | none, F.col(text)).otherwise(joined))
    if replaced is not None:
        changed = F.size(F.filter(F.zip_with("_found", "_fresh", lambda a, b: a != b), lambda x: x))
        out = out.withColumn(replaced, F.when(F.col(text).isNull(), 0).otherwise(changed).cast("long"))
    return out.drop("_found", "_fresh")
