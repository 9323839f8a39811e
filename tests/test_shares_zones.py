from __future__ import annotations

import random

from conftest import rows

from zonetide.operators import registrars, shares, zones

COMPANY = "canonical_domain string, in_sp500 boolean, in_russell1000 boolean, in_russell3000 boolean, in_us_public boolean"
PROBE = "snap_month string, domain string, ns_provider string, analytics_provider string, dnssec boolean, has_aaaa boolean, caa_present boolean, has_mx boolean"


def tiered(spark):
    probes = spark.createDataFrame(
        [
            ("2026-01", "a.com", "cf", "ga4, gtm,ga4", True, None, True, True),
            ("2026-01", "b.com", "cf", None, False, None, True, False),
            ("2026-01", "c.com", None, "", None, None, None, None),
            ("2026-02", "a.com", "r53", "ga4", True, True, True, True),
            ("2026-04", "a.com", "r53", "ga4", True, True, True, True),
        ],
        PROBE,
    )
    companies = spark.createDataFrame([("a.com", True, False, True, True), ("b.com", False, False, True, True)], COMPANY)
    ranks = spark.createDataFrame([("c.com", "2026-01", 100), ("a.com", "2026-02", 101), ("b.com", "2026-02", 1)], "domain string, snap_month string, rank bigint")
    return shares.with_tiers(probes, companies, ranks)


def test_tiers(spark):
    found = {(r.snap_month, r.domain): set(r.tiers) for r in tiered(spark).collect()}
    company = {"sp500", "russell3000", "all_us_public"}
    assert found[("2026-01", "a.com")] == company | {"all"}
    assert found[("2026-01", "c.com")] == {"tranco100", "tranco1000", "tranco10000", "all"}
    assert found[("2026-02", "a.com")] == company | {"tranco1000", "tranco10000", "all"}


def test_shares(spark):
    found = {tuple(r)[:4]: tuple(r)[4:] for r in shares.provider_share(tiered(spark)).collect()}
    assert found[("2026-01", "all", "ns", "cf")] == (2, 3, 2 / 3)
    assert found[("2026-01", "all", "analytics", "ga4")] == (1, 3, 1 / 3)
    assert found[("2026-01", "sp500", "analytics", "gtm")] == (1, 1, 1.0)
    assert found[("2026-01", "russell3000", "ns", "cf")] == (2, 2, 1.0)
    assert not any(k[1] == "tranco100" for k in found)  # no provider seen, so no row


def test_deltas_need_the_month_before(spark):
    found = {(r.snap_month, r.provider_key): (r.delta_count, r.delta_share) for r in shares.month_over_month(shares.provider_share(tiered(spark))).filter("tier = 'sp500' and category <> 'mx'").collect()}
    assert found[("2026-01", "cf")] == (None, None)
    assert found[("2026-02", "r53")] == (None, None)
    assert found[("2026-02", "ga4")] == (0, 0.0)
    assert found[("2026-04", "ga4")] == (None, None)


def test_one_provider_each_sums_to_total(spark):
    rng = random.Random(2)
    probes = spark.createDataFrame([("2026-01", f"d{i}", rng.choice("abc"), ["all"]) for i in range(300)], "snap_month string, domain string, ns_provider string, tiers array<string>")
    found = shares.provider_share(probes).collect()
    assert sum(r["count"] for r in found) == 300 == found[0].total


def test_adoption(spark):
    found = {(r.snap_month, r.tier): r for r in shares.adoption_rates(tiered(spark)).collect()}
    row = found[("2026-01", "all")]
    assert (row.dnssec_rate, row.ipv6_rate, row.caa_rate, row.mx_rate) == (0.5, None, 1.0, 0.5)


def test_modal_value(spark):
    df = spark.createDataFrame([("a", "US"), ("a", "DE"), ("a", None), ("b", "US"), ("b", "FR"), ("b", "US"), ("c", None)], "domain string, country string")
    assert rows(shares.modal_value(df, ["domain"], "country")) == [("a", "DE"), ("b", "US")]


ZONE = "snap_date string, tld string, domain string"


def brute_history(snapshots):
    by_tld = {}
    for day, tld, name in snapshots:
        by_tld.setdefault(tld, {}).setdefault(day, set()).add(name)
    out = []
    for tld, days in by_tld.items():
        before = None
        for day in sorted(days):
            now = days[day]
            out.append((day, tld, len(now), len(now - before) if before is not None else 0, len(before - now) if before is not None else 0))
            before = now
    return sorted(out, key=repr)


def test_zone_history(spark):
    rng = random.Random(4)
    # One TLD holds most names, days differ per TLD, rows repeat.
    data = [(f"2026-01-{rng.randrange(1, 9):02d}", rng.choice(["com", "com", "com", "net", "io"]), f"n{rng.randrange(40)}") for _ in range(600)]
    df = spark.createDataFrame(data, ZONE).repartition(6)
    found = zones.zone_history(df)
    assert rows(found) == brute_history(data)
    for tld in ("com", "net"):
        days = found.filter(found.tld == tld).orderBy("snap_date").collect()
        for before, now in zip(days, days[1:]):
            assert now.registered_total - before.registered_total == now.new_today - now.dropped_today


def test_zone_diff(spark):
    before = spark.createDataFrame([("com", "a"), ("com", "b"), ("org", "x")], "tld string, domain string")
    now = spark.createDataFrame([("com", "b"), ("com", "c"), ("com", "d"), ("net", "n")], "tld string, domain string")
    assert rows(zones.zone_diff(before, now)) == [("com", 3, 2, 1), ("net", 1, 1, 0), ("org", 0, 0, 1)]


def test_registrars(spark):
    monthly = spark.createDataFrame(
        [("2026-01", 1, "com", 30, 100), ("2026-01", 2, "com", 10, 300), ("2026-02", 1, "com", 0, 120), ("2026-04", 1, "com", 5, 130)],
        "report_month string, iana_id bigint, tld string, net_adds bigint, domains_under_mgmt bigint",
    )
    names = spark.createDataFrame([(1, "One Inc.", None)], "iana_id bigint, name string, display_name string")
    columns = ["iana_id", "report_month", "tld", "net_adds", "domains_under_mgmt", "net_adds_share", "domains_under_mgmt_share", "growth", "registrar"]
    assert rows(registrars.market_share(monthly, names).select(*columns)) == [
        (1, "2026-01", "com", 30, 100, 0.75, 0.25, None, "One Inc."),
        (1, "2026-02", "com", 0, 120, None, 1.0, 20, "One Inc."),
        (1, "2026-04", "com", 5, 130, 1.0, 1.0, None, "One Inc."),
        (2, "2026-01", "com", 10, 300, 0.25, 0.75, None, None),
    ]
    coverage = spark.createDataFrame(
        [(1, "com", True, 900, "2026-01-01"), (1, "com", True, 1100, "2026-03-01"), (1, "net", False, 500, None), (2, "com", True, 700, None)],
        "iana_id bigint, tld string, carries boolean, first_year_cents bigint, last_verified_at string",
    )
    latest = registrars.latest_coverage(coverage)
    assert rows(latest.select("iana_id", "tld", "first_year_cents")) == [(1, "com", 1100), (1, "net", 500), (2, "com", 700)]
    assert rows(registrars.price_matrix(latest, ["com", "net"])) == [(1, 1100, None), (2, 700, None)]
