from __future__ import annotations

import json

import pytest
from conftest import rows

from zonetide.operators import aggregates, probes, rdap
from zonetide.plans.jobs import probe_statistics
from zonetide.plans.reports import upload_document
from zonetide.sources.captures import DNS_ANSWERS, HTTP_RESPONSES, RDAP_RESPONSES


@pytest.mark.parametrize(
    "http_status, body, error, registered",
    [
        (200, '{"Status":0,"Answer":[{}]}', False, True),
        (200, '{"Status":0,"Answer":[]}', False, False),
        (200, '{"Status":0}', False, False),
        (200, '{"Status":3}', False, False),
        (200, '{"Status":3,"Answer":[{}]}', False, False),
        (500, '{"Status":0,"Answer":[{}]}', True, None),
        (200, "<html>", True, None),
        (200, "{}", True, None),
        (200, '{"Status":null}', True, None),
        (200, "[]", True, None),
        (200, None, True, None),
    ],
)
def test_dns_verdict(spark, http_status, body, error, registered):
    answer = spark.createDataFrame([("a.com", "r", 0, http_status, body)], DNS_ANSWERS)
    assert rows(probes.dns_verdicts(answer).select("resolver_error", "registered")) == [(error, registered)]


def test_resolver_fallback(spark):
    good, bad, none = '{"Status":0,"Answer":[{}]}', "x", '{"Status":3}'
    answers = spark.createDataFrame(
        [("a.com", "r1", 0, 200, bad), ("a.com", "r2", 1, 200, good), ("a.com", "r3", 2, 200, none), ("b.com", "r1", 0, 500, good)],
        DNS_ANSWERS,
    )
    verdicts = probes.dns_verdicts(answers)
    assert rows(probes.resolve(verdicts)) == [("a.com", True, False), ("b.com", False, True)]
    assert rows(probes.resolver_counts(verdicts)) == [("r1", 0, 2), ("r2", 1, 0), ("r3", 1, 0)]


FAR = b"<p>" + b"x" * 4096 + b" parked domain pricing"


@pytest.mark.parametrize(
    "status, content_type, body, error, usage, product",
    [
        (200, "text/html", b"<p>hi", None, "active_site", "unknown"),
        (200, "text/html", b"This domain is FOR SALE", None, "parked_or_placeholder", "unknown"),
        (200, "text/html", b" \n\t", None, "no_website", "unknown"),
        (200, "application/json", b"{}", None, "no_website", "unknown"),
        (200, "text/html; charset=utf-8", FAR, None, "active_site", "unknown"),
        (404, "text/html", b"pricing", None, "no_website", "unknown"),
        (503, "text/html", b"parked domain", None, "no_website", "unknown"),
        (302, "text/html", b"moved", None, "parked_or_placeholder", "unknown"),
        (200, "text/html", b"Sign Up now", None, "active_site", "active_product"),
        (200, "text/plain", b"See our Pricing", None, "no_website", "active_product"),
        (None, None, None, "timeout", "no_website", "unknown"),
        (200, "text/html", b"par\xffked dom\xc3ain", None, "parked_or_placeholder", "unknown"),
        (200, "text/html", b"\xff\xfe", None, "no_website", "unknown"),
    ],
)
def test_usage_state(spark, status, content_type, body, error, usage, product):
    response = spark.createDataFrame([("a.com", status, content_type, bytearray(body) if body is not None else None, error)], HTTP_RESPONSES)
    assert rows(probes.http_usage(response, body_limit=4096).select("usage_state", "product_state")) == [(usage, product)]


def test_whole_body_by_default(spark):
    response = spark.createDataFrame([("a.com", 200, "text/html", bytearray(FAR), None)], HTTP_RESPONSES)
    assert rows(probes.http_usage(response).select("usage_state")) == [("parked_or_placeholder",)]


NAMES = [
    ("ab.com", False, "no_website"),
    ("ac.com", True, "active_site"),
    ("ad.com", True, "parked_or_placeholder"),
    ("ab.net", True, "no_website"),
    ("abc.net", False, "no_website"),
]


def names(spark, mode):
    df = spark.createDataFrame([(*n, mode) for n in NAMES], "domain string, registered boolean, usage_state string, mode string")
    return probes.with_label(df)


def test_block_of_five(spark):
    cells = aggregates.probe_cells(names(spark, "short"))
    assert rows(aggregates.global_totals(cells)) == [(5, 5)]
    lengths = aggregates.length_stats(cells)
    assert rows(lengths) == [(2, 1296, 4, 1, 2), (3, 46656, 1, 1, 0)]
    by_tld = aggregates.length_stats_by_tld(cells)
    assert rows(by_tld) == [("com", 2, 1296, 3, 1, 1), ("net", 2, 1296, 1, 0, 1), ("net", 3, 46656, 1, 1, 0)]
    assert rows(aggregates.tld_stats(cells)) == [("com", 3, 3, 1, 1, 1), ("net", 2, 2, 1, 1, 0)]
    assert rows(aggregates.batch_summary(lengths)) == [(5, "L2=4, L3=1")]


def test_word_mode(spark):
    probed = names(spark, "words")
    cells = aggregates.probe_cells(probed)
    assert rows(aggregates.global_totals(cells)) == [(5, 5)]
    assert aggregates.length_stats(cells).count() == 0
    assert aggregates.length_stats_by_tld(cells).count() == 0
    assert rows(aggregates.tld_stats(cells)) == [("com", 3, 3, 1, 1, 1), ("net", 2, 2, 1, 1, 0)]
    assert rows(aggregates.batch_summary(aggregates.length_stats(cells))) == [(0, "none")]
    pos = spark.createDataFrame([("ab", "noun"), ("ad", "verb"), ("zz", "adv")], "word string, pos string")
    assert rows(aggregates.word_pos_stats(probed, pos)) == [("noun", 2, 2, 1, 1), ("verb", 2, 1, 0, 1)]
    assert aggregates.word_pos_stats(names(spark, "short"), pos).count() == 0


def test_no_names(spark):
    cells = aggregates.probe_cells(names(spark, "short").limit(0))
    assert rows(aggregates.global_totals(cells)) == [(0, 0)]


def test_rollups_agree(spark):
    cells = aggregates.probe_cells(names(spark, "short").unionByName(names(spark, "words")))
    picked = {(r.level, r.tld, r.length): r.tracked_count for r in aggregates.all_aggregates(cells).collect()}
    assert picked[("global", None, None)] == 10
    assert picked[("length", None, 2)] == sum(v for k, v in picked.items() if k[0] == "tld_length" and k[2] == 2) == 4
    assert sum(v for k, v in picked.items() if k[0] == "tld") == 10


def test_coverage_only_per_tld(spark):
    df = spark.createDataFrame([("ALL", 72, 36), ("com", 18, 36)], "tld string, tracked_count bigint, total_possible bigint")
    assert rows(aggregates.with_coverage(df).select("tld", "coverage")) == [("ALL", None), ("com", 0.5)]


def test_from_captures_to_document(spark):
    up = '{"Status":0,"Answer":[{}]}'
    dns = spark.createDataFrame(
        [(d, "r", 0, 200, up if registered else '{"Status":3}') for d, registered, _ in NAMES], DNS_ANSWERS
    )
    bodies = {"active_site": b"hello", "parked_or_placeholder": b"domain parking", "no_website": b""}
    http = spark.createDataFrame([(d, 200, "text/html", bytearray(bodies[u]), None) for d, _, u in NAMES], HTTP_RESPONSES)
    none = spark.createDataFrame([], "word string, pos string")
    stats = probe_statistics(dns, http, none, "short")
    document = json.loads(
        upload_document("2026-01-01", stats.totals, stats.lengths, stats.tld_lengths, stats.words, "run", None).head().value
    )
    assert document["global"] == {"domains_tracked_lifetime": 5, "domains_tracked_24h": 5}
    assert [r["length"] for r in document["length_stats"]] == [2, 3]
    assert [(r["tld"], r["length"], r["unused_found"]) for r in document["length_stats_by_tld"]] == [("com", 2, 1), ("net", 2, 1), ("net", 3, 0)]
    assert document["word_pos_stats"] == [] and document["run_id"] == "run" and "batch_id" not in document


def entity(role, ids, name="MarkMonitor Inc."):
    return {"roles": [role], "publicIds": ids, "vcardArray": ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", name], ["fn", {}, "text", "second"]]]}


IANA = {"type": "IANA Registrar ID", "identifier": "292"}


@pytest.mark.parametrize(
    "answers, verdict",
    [
        ([(0, 200, {"entities": [entity("abuse", []), entity("Registrar", [IANA])]})], (True, 292, "MarkMonitor Inc.")),
        ([(0, 200, {"entities": [entity("registrar", [IANA, {"type": "iana", "identifier": "x"}])]})], (True, 292, "MarkMonitor Inc.")),
        ([(0, 200, {"entities": [entity("registrar", [IANA, {"type": "iana", "identifier": "7"}])]})], (True, 7, "MarkMonitor Inc.")),
        ([(0, 200, {"entities": [{"roles": ["registrar"]}, entity("registrar", [IANA])]})], (True, None, None)),
        ([(0, 200, {"entities": [7, "x", entity("registrar", [IANA])]})], (True, 292, "MarkMonitor Inc.")),
        ([(0, 200, {"entities": []})], (True, None, None)),
        ([(0, 200, {"entities": {"roles": ["registrar"]}})], (True, None, None)),
        ([(0, 200, {"entities": [{"roles": ["REGISTRAR"], "publicIds": [5, IANA], "vcardArray": ["vcard", ["odd", ["fn", {}, "text", "N"]]]}]})], (True, 292, "N")),
        ([(0, 200, "[1]"), (1, 404, {})], (False, None, None)),
        ([(0, 200, {})], (True, None, None)),
        ([(0, 404, {})], (False, None, None)),
        ([(0, 500, {}), (1, 404, {})], (False, None, None)),
        ([(0, 200, "bad"), (1, 200, {"entities": [entity("registrar", [IANA])]})], (True, 292, "MarkMonitor Inc.")),
        ([(0, 500, {})], (None, None, None)),
    ],
)
def test_rdap(spark, answers, verdict):
    bodies = [("a.com", n, s, b if isinstance(b, str) else json.dumps(b)) for n, s, b in answers]
    assert rows(rdap.rdap_verdicts(spark.createDataFrame(bodies, RDAP_RESPONSES)).drop("domain")) == [verdict]


def test_rdap_without_dot_or_endpoint(spark):
    answers = spark.createDataFrame([("localhost", 0, 404, "{}")], RDAP_RESPONSES)
    assert rows(rdap.rdap_verdicts(answers)) == [("localhost", None, None, None)]
    endpoints = spark.createDataFrame([("com", 0, "https://a")], "tld string, endpoint_ord int, url string")
    asked = rdap.endpoints_for(spark.createDataFrame([("x.COM",), ("y.zz",), ("com",)], "domain string"), endpoints)
    assert rows(asked.select("domain", "url")) == [("com", None), ("x.COM", "https://a"), ("y.zz", None)]
