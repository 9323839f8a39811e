from __future__ import annotations

import pytest
from conftest import one
from pyspark.sql import functions as F

from zonetide.functions import numbers, text, times
from zonetide.operators.tlds import classify_tld


@pytest.mark.parametrize(
    "index, length, label",
    [(0, 3, "aaa"), (1, 3, "aab"), (35, 3, "aa9"), (36, 3, "aba"), (46655, 3, "999"), (46656, 3, "aaa"), (36**10 - 1, 10, "9999999999")],
)
def test_label_of_index(spark, index, length, label):
    assert one(spark, lambda v: numbers.index_to_label(v, length), index, "bigint") == label


def test_label_of_index_with_another_alphabet(spark):
    assert one(spark, lambda v: numbers.index_to_label(v, 4, "xyz"), 5, "bigint") == "xxyz"


@pytest.mark.parametrize("length, space", [(1, 36), (2, 1296), (10, 3656158440062976)])
def test_label_space(spark, length, space):
    assert one(spark, lambda v: numbers.label_space(F.col(v)), length, "int") == space


@pytest.mark.parametrize(
    "given, host",
    [
        (" HTTPS://www.Ex.com/a?b ", "ex.com"),
        ("ex.com?a/b", "ex.com"),
        ("www.www.ex.com", "www.ex.com"),
        ("ex.com:8080/x", "ex.com:8080"),
        ("ex.com#top", "ex.com#top"),
        (" \thttp://EX.org\n", "ex.org"),
    ],
)
def test_normalize_domain(spark, given, host):
    assert one(spark, text.normalize_domain, given) == host


def test_ticker_domain_and_cik(spark):
    assert one(spark, text.domain_from_ticker, "BRK-B") == "brkb.com"
    assert one(spark, text.pad_cik, "320193") == "0000320193"
    assert one(spark, text.pad_cik, "123456789012") == "123456789012"


@pytest.mark.parametrize(
    "tld, kind, place",
    [
        ("com", "gTLD", "INT"),
        ("de", "ccTLD", "DE"),
        ("gov", "sTLD", "US"),
        ("int", "sTLD", "INT"),
        ("xn--p1ai", "gTLD", "INT"),
        ("asia", "sTLD", "INT"),
        ("a1", "gTLD", "INT"),
    ],
)
def test_classify_tld(spark, tld, kind, place):
    assert tuple(one(spark, classify_tld, tld)) == (kind, place)


@pytest.mark.parametrize(
    "line, word",
    [(" Tree\t", "tree"), ("İ", ""), ("\u00a0caf\u00c9\u2003", "café"), ("two words", ""), ("abcdefghijk", ""), ("", ""), ("\x1cab\x1f", "ab"), ("don't", ""), ("abcdefghij", "abcdefghij"), ("a1", ""), ("tree", "tree")],
)
def test_as_word(spark, line, word):
    assert one(spark, text.as_word, line) == word


@pytest.mark.parametrize(
    "given, number",
    [("1,234", 1234), ("-5", -5), ("", 0), (None, 0), ("12.0", 0), ("x", 0), (" 7 ", 7), ("1,2,3", 123)],
)
def test_report_number(spark, given, number):
    assert one(spark, numbers.report_number, given) == number


def test_report_tld(spark):
    assert one(spark, text.report_tld, " ..COM") == "com"


@pytest.mark.parametrize("given, number", [("12", 12), ("", 0), (None, 0), ("abc", 0), ("1e3", 1000), ("NaN", 0)])
def test_number_or_zero(spark, given, number):
    assert one(spark, numbers.number_or_zero, given) == number


def test_provider_list(spark):
    assert one(spark, text.provider_list, "ga4, gtm,,ga4,HubSpot ") == ["ga4", "gtm", "hubspot"]


NOW = "2026-05-02 12:00:00"


@pytest.mark.parametrize(
    "given, age",
    [
        ("2026-05-01 05:31:00", 30),
        ("2026-05-01 05:30:00", 31),
        ("2026-05-02T12:00:00Z", 0),
        ("2026-05-02T14:00:00+02:00", 0),
        ("2026-05-02T14:00:00+0200", 0),
        ("soon", None),
        (None, None),
    ],
)
def test_age_hours(spark, given, age):
    assert one(spark, lambda v: times.age_hours(v, NOW), given) == age


def test_age_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, lambda v: times.age_hours(v, NOW), "2026-05-02 10:00:00") == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("months, first", [(1, "2026-03"), (12, "2025-03"), (0, "2025-03"), (None, "2025-03"), (99, "2023-03"), (-1, None)])
def test_history_window(spark, months, first):
    assert one(spark, lambda _: times.month_window_start("2026-03-31 08:00:00", months)) == first


def test_report_months():
    assert times.report_months("2026-12-01") == ["2026-10", "2026-09", "2026-08"]
    assert times.report_months("2026-01-31", 4) == ["2025-11", "2025-10", "2025-09", "2025-08"]


def test_previous_month(spark):
    assert one(spark, times.previous_month, "2026-01") == "2025-12"


def test_large_integers_stay_exact(spark):
    from zonetide.functions.numbers import number_or_zero

    texts = {"9007199254740993": 9007199254740993, "-9223372036854775808": -(2**63), "1e3": 1000, "12.7": 12, "x": 0, "": 0, " 7 ": 7, "NaN": 0, "99999999999999999999": 0}
    df = spark.createDataFrame([(k,) for k in texts], "v string")
    assert {r.v: r.n for r in df.select("v", number_or_zero("v").alias("n")).collect()} == texts
    assert spark.range(1).select(number_or_zero(F.lit(9007199254740993)).alias("n")).head().n == 9007199254740993
