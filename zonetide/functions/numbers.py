"""Numbers: label space, lenient parsing, coercion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import LABEL_ALPHABET
from .text import col, strip

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def label_space(length: Column | int, base: int = len(LABEL_ALPHABET)) -> Column:
    """``base ** length``; exact while below 2^53, which ten symbols of 36 are."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.pow(F.lit(base), length).cast("bigint")


def index_to_label(
    index: Column | str, length: Column | int, alphabet: str = LABEL_ALPHABET
) -> Column:
    """Fixed-width big-endian label of a position in the label space (up to 36 symbols)."""
    base = len(alphabet)
    width = F.lit(length) if isinstance(length, int) else length
    inside = F.pmod(col(index), label_space(width, base))
    digits = F.lower(F.conv(inside.cast("string"), 10, base))
    return F.translate(F.lpad(digits, width, F.lit("0")), _DIGITS[:base], alphabet)


def report_number(value: Column | str) -> Column:
    """Integer with optional thousands commas; anything else counts as 0."""
    digits = F.replace(strip(value), F.lit(","), F.lit(""))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def integer_or_null(value: Column | str) -> Column:
    return strip(value).try_cast("bigint")


def number_or_zero(value: Column | str, kind: str = "bigint") -> Column:
    """Lenient number: what does not parse, or is missing, counts as 0. Integers are taken as they are, however large."""
    number = col(value).try_cast("double")
    number = F.when(~F.isnan(number), number)
    whole = col(value).cast("string").try_cast(kind) if kind == "bigint" else F.lit(None)
    return F.coalesce(whole, number.try_cast(kind), F.lit(0).cast(kind))


def flag(value: Column | str) -> Column:
    """0/1 with missing as 0."""
    return F.coalesce(col(value).cast("int"), F.lit(0))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0).cast("bigint"))
