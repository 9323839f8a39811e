"""Names, words and other text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from .fixed import MAX_LENGTH

# All Unicode white space, plus the four ASCII separators: as trim characters and as a
# pattern. Trimming is no regex; splitting is faster with this class than with the list.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"[\s\x1c-\x1f]"
SPACES = rf"(?U){_SPACE}+"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.trim(col(value), F.lit(WHITE_SPACE))


def is_blank(value: Column | str) -> Column:
    return F.coalesce(F.ltrim(col(value), F.lit(WHITE_SPACE)), F.lit("")) == ""


def contains_any(value: Column | str, phrases: Iterable[str]) -> Column:
    """True if ``value`` holds one of the literal ``phrases``; false for no phrases."""
    value = col(value)
    return reduce(lambda a, p: a | value.contains(p), phrases, F.lit(False))


def normalize_domain(value: Column | str) -> Column:
    """Bare lower-case host: no scheme, no leading ``www.``, nothing after ``/`` or ``?``."""
    host = F.lower(strip(value))
    host = F.regexp_replace(host, r"^https?://", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.substring_index(F.substring_index(host, "/", 1), "?", 1)


def domain_from_ticker(ticker: Column | str) -> Column:
    return F.concat(F.regexp_replace(F.lower(col(ticker)), "[^a-z0-9]", ""), F.lit(".com"))


def pad_cik(cik: Column | str) -> Column:
    """Zero-pad to ten digits; longer values keep all their digits."""
    cik = col(cik)
    return F.lpad(cik, F.greatest(F.length(cik), F.lit(10)), F.lit("0"))


def domain_label(domain: Column | str) -> Column:
    return F.substring_index(col(domain), ".", 1)


def domain_tld(domain: Column | str) -> Column:
    return F.lower(F.substring_index(col(domain), ".", -1))


def as_word(line: Column | str, max_length: int = MAX_LENGTH) -> Column:
    """The word a line holds, trimmed and in lower case; empty if it holds none.

    Lower case comes first, as it can turn a letter into a letter and a mark. One match does
    the trimming and both checks.
    """
    pattern = rf"(?U)^{_SPACE}*(\p{{L}}{{1,{max_length}}}){_SPACE}*\z"
    return F.regexp_extract(F.lower(col(line)), pattern, 1)


def report_tld(value: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(value)), r"^\.+", "")


def or_default(value: Column | str, default: str) -> Column:
    """Default for a missing or empty text."""
    value = col(value)
    return F.when(value.isNull() | (value == ""), F.lit(default)).otherwise(value)


def provider_list(csv: Column | str) -> Column:
    """Distinct, non-blank entries of a comma-separated text, each counted once."""
    tidy = F.regexp_replace(F.lower(strip(csv)), rf"(?U){_SPACE}*,{_SPACE}*", ",")
    return F.array_remove(F.array_distinct(F.split(tidy, ",")), "")
