from __future__ import annotations

import csv
import json
import random

from conftest import rows
from pyspark.sql import functions as F

from zonetide.operators.upsert import POLICIES, prepare
from zonetide.plans.jobs import build_corpus, build_dictionary, build_tld_dimension, corpus_from_files, ingest_registrar_reports
from zonetide.plans.ledger import export_words
from zonetide.sources import batches, captures, companies, lists
from zonetide.sources.registrar_reports import cell_count, header_positions, read_registrar_reports


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_tld_lists(spark):
    iana = lines(spark, "# Version 1", "COM", " De\t", "", "   ", "XN--P1AI", "GOV")
    zones = lines(spark, "Com\tVerisign", "# x", "com", "")
    assert rows(lists.tld_list(iana)) == [("com",), ("de",), ("gov",), ("xn--p1ai",)]
    assert rows(lists.zone_available(zones)) == [("com",)]
    assert rows(build_tld_dimension(iana, zones)) == [
        ("com", "gTLD", "INT", True, "active"),
        ("de", "ccTLD", "DE", False, "active"),
        ("gov", "sTLD", "US", False, "active"),
        ("xn--p1ai", "gTLD", "INT", False, "active"),
    ]


def test_word_list(spark, tmp_path):
    (tmp_path / "w.txt").write_text("b\n\n  a \n \n")
    assert rows(lists.word_list(lists.read_lines(spark, str(tmp_path / "w.txt")))) == [("a",), ("b",)]


def test_dictionary(spark, tmp_path):
    source = spark.createDataFrame(
        [("noun", "Tree "), ("noun", "run"), ("verb", "run"), ("verb", "don't"), ("adj", "café"), ("adv", "abcdefghijk"), ("adv", "tree"), ("noun", " ")],
        "pos string, word string",
    )
    built = build_dictionary(source)
    assert rows(built.words) == [("adj", "café"), ("adv", "tree"), ("noun", "run"), ("noun", "tree"), ("verb", "run")]
    assert rows(built.union) == [("café",), ("run",), ("tree",)]
    assert rows(built.index) == [("café", "adj"), ("run", "noun"), ("tree", "noun")]
    out = str(tmp_path / "words")
    export_words(built.union, out)
    assert [r.value for r in spark.read.text(out).collect()] == ["café", "run", "tree"]


def resolve_header(spark, headers):
    df = spark.createDataFrame([(headers,)], "cells array<string>")
    found = df.select(*[p.alias(f) for f, p in header_positions(F.col("cells")).items()]).head()
    return {f: p for f, p in found.asDict().items() if p is not None}


def test_header_hints(spark):
    found = resolve_header(spark, ["Registrar Name", " IANA-ID", "TLD", "Net Adds 1-Year", "Net Adds 2-Year"])
    assert found == {"iana_id": 1, "registrar_name": 0, "tld": 2, "net_adds": 3}
    assert "tld" not in resolve_header(spark, ["iana id", "name", None])


def test_cell_count(spark):
    records = {"a,b": 2, "": 1, '"a,b",c': 2, '"a""b,c""",,': 3, '"x\ny",1': 2, ",".join(['"q,q"'] * 20_000): 20_000}
    df = spark.createDataFrame([(r,) for r in records], "r string")
    assert {r.r: r.n for r in df.select("r", cell_count(F.col("r")).alias("n")).collect()} == records


def test_registrar_reports_in_one_scan(spark, tmp_path):
    rng = random.Random(8)
    want = []
    for n in range(30):
        month = f"20{10 + n // 12}-{n % 12 + 1:02d}"
        extra = [f"Note {k}" for k in range(rng.randrange(4))]
        header = ["Registrar\nName", "IANA ID", "TLD", "Net Adds", "renewals", *extra]
        rng.shuffle(header)
        with open(tmp_path / f"r-{month}-en.csv", "w", newline="") as file:
            out = csv.writer(file)
            out.writerow(header)
            for i in range(40):
                row = {"Registrar\nName": rng.choice(["A, Inc.", 'the "B"', "two\nlines\n", "", "plain"]), "IANA ID": str(i + 1), "TLD": rng.choice([".com", "net", ""]), "Net Adds": rng.choice(["1,234", "", "x", "7"]), "renewals": str(n)}
                cells = [row.get(h, rng.choice(["", "a,b", "line\nbreak", "long " * 2000])) for h in header]
                short, long = rng.random() < 0.1, rng.random() < 0.2
                cells = cells[:-1] if short else cells + ['more "quoted", cells'] * (300 * long)
                out.writerow(cells)
                if not short and row["TLD"]:
                    want.append((month, i + 1, row["TLD"].lstrip("."), {"1,234": 1234, "7": 7}.get(row["Net Adds"], 0), n))
    (tmp_path / "r-2001-01-en.csv").write_text("")
    (tmp_path / "r-2001-02-en.csv").write_text("IANA ID,other\n1,2\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("reports", "")
    found = read_registrar_reports(spark, str(tmp_path))
    got = found.select("report_month", "iana_id", "tld", "net_adds", "renewals").collect()
    jobs = len(tracker.getJobIdsForGroup("reports"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == sorted(want)
    assert jobs < 12
    # files of other months aren't opened: a file that can't be read does no harm
    (tmp_path / "r-2030-01-en.csv.gz").write_bytes(b"no gzip")
    some = read_registrar_reports(spark, str(tmp_path), ["2010-03", "2011-01"])
    assert sorted(map(tuple, some.select("report_month", "iana_id", "tld", "net_adds", "renewals").collect())) == sorted(w for w in want if w[0] in ("2010-03", "2011-01"))


def test_registrar_reports(spark, tmp_path):
    (tmp_path / "mrr-2026-09-en.csv").write_text(
        "Registrar Name,IANA-ID,TLD,Net Adds 1-Year,Renewals,DUM\n"
        "A,1, ..COM,\"1,234\",5,100\n"
        "B,2,net,1\n"
        "C,3,org,x,,7,extra\n"
        "D,x,org,1,2,3\n"
        '"E, Inc.",5,,1,2,3\n'
        "F,6,biz,,12.0,-5\n"
    )
    (tmp_path / "mrr-2026-10-en.csv").write_text("gTLD,registrar-id,end-of-month-domains\ncom,1,110\n")
    (tmp_path / "mrr-2026-08-en.csv").write_text("Registrar Name,IANA-ID,Net Adds\nA,1,5\n")
    found = read_registrar_reports(spark, str(tmp_path))
    assert rows(found.drop("source_url")) == [
        ("2026-09", 1, "com", 1234, 5, 0, 0, 100),
        ("2026-09", 3, "org", 0, 0, 0, 0, 7),
        ("2026-09", 6, "biz", 0, 0, 0, 0, -5),
        ("2026-10", 1, "com", 0, 0, 0, 0, 110),
    ]
    due = ingest_registrar_reports(spark, str(tmp_path), now="2026-12-01", months_back=1)
    assert rows(due.select("report_month", "iana_id")) == [("2026-10", 1)]
    one = ingest_registrar_reports(spark, str(tmp_path), month="2026-08")
    assert one.count() == 0


TICKERS = {
    "0": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple Inc."},
    "1": {"cik_str": 1652044, "ticker": "GOOGL", "title": "Alphabet Inc."},
    "2": {"cik_str": 1652044, "ticker": "GOOG", "title": "Alphabet Inc."},
    "3": {"cik_str": 1067983, "ticker": "BRK-B", "title": "Berkshire"},
    "4": 7,
    "5": {"cik_str": 5, "ticker": " ", "title": "No ticker"},
    "6": {"ticker": "NOCIK", "title": "No CIK"},
    "7": {"cik_str": 77, "ticker": "BYCIK", "title": "By CIK"},
}
OVERRIDES = {"_comment": "text", "googl": "google.com", "goog": "google.com", "brkb": "berkshirehathaway.com", "77": "HTTPS://www.ByCik.org/x"}
PAGE = """<a>NOPE</a><table class="wikitable sortable">
<tr><td><a href="x">AAPL</a></td></tr><tr><td><a>BRK.B</a></td><td><a>lower</a></td></tr></table>
<table class="other"><a>OUT</a></table><table class='wikitable'><a>TOOLONGX</a><a>AAPL</a></table>"""
RANKS = "1,google.com\n2,WWW.Example.com\n3\nx,bad.com\n4,example.com/\n20000,far.com\n5,\n"


def _files(tmp_path):
    (tmp_path / "tickers.json").write_text(json.dumps(TICKERS))
    (tmp_path / "overrides.json").write_text(json.dumps(OVERRIDES))
    (tmp_path / "page.html").write_text(PAGE)
    (tmp_path / "ranks.csv").write_text(RANKS)
    return [str(tmp_path / n) for n in ("tickers.json", "overrides.json", "page.html", "ranks.csv")]


def test_corpus_sources(spark, tmp_path):
    tickers, overrides, page, ranks = _files(tmp_path)
    assert [r.ticker for r in companies.ticker_rows(companies.read_document(spark, tickers)).orderBy("pos").collect()] == [
        "AAPL", "GOOGL", "GOOG", "BRK-B", "BYCIK",
    ]
    assert rows(companies.index_tickers(companies.read_document(spark, page))) == [("AAPL",), ("BRK.B",)]
    twice = lines(spark, '{"AAPL":"Old.com","aapl":"New.com"}')
    assert rows(companies.domain_overrides(twice)) == [("aapl", "new.com")]
    assert ("77", "https://www.bycik.org/x") in rows(companies.domain_overrides(companies.read_document(spark, overrides)))
    assert rows(companies.read_site_ranks(spark, ranks, "2026-10", limit=10_000)) == [
        ("example.com", "2026-10", 2), ("example.com", "2026-10", 4), ("google.com", "2026-10", 1),
    ]
    assert "far.com" in {r.domain for r in companies.read_site_ranks(spark, ranks, "2026-10").collect()}  # no limit unless asked for


def test_corpus(spark, tmp_path):
    built = corpus_from_files(spark, *_files(tmp_path), "2026-10", rank_limit=10_000)
    found = {r.canonical_domain: r for r in built.companies.collect()}
    assert set(found) == {"aapl.com", "google.com", "brkb.com", "bycik.org", "example.com"}
    assert found["google.com"].ticker == "GOOGL"
    assert found["aapl.com"].sec_cik == "0000320193"
    assert found["aapl.com"].in_sp500 and not found["brkb.com"].in_sp500
    assert all(r.in_russell3000 == (r.ticker is not None) for r in found.values())
    assert not any(r.in_russell1000 for r in found.values())
    assert found["example.com"].name == "example.com" and not found["example.com"].in_us_public


def test_corpus_options(spark, tmp_path):
    tickers, overrides, page, ranks = _files(tmp_path)
    doc = companies.read_document
    stored = spark.createDataFrame([("example.com",)], "canonical_domain string")
    built = build_corpus(
        companies.ticker_rows(doc(spark, tickers)),
        companies.domain_overrides(doc(spark, overrides)),
        companies.index_tickers(doc(spark, page)),
        companies.read_site_ranks(spark, ranks, "2026-10", limit=10_000),
        stored,
        normalize_class=True,
    )
    found = {r.canonical_domain: r.in_sp500 for r in built.companies.collect()}
    assert "example.com" not in found and found["brkb.com"]


def test_bootstrap(spark):
    document = {"services": [[["COM", "net"], ["https://a/", "https://b//"]], [["net"], ["https://c"]], ["odd"], [["x"]], 5]}
    assert rows(captures.rdap_endpoints(lines(spark, json.dumps(document)))) == [
        ("com", 0, "https://a"), ("com", 1, "https://b"), ("net", 0, "https://c"),
    ]


def test_row_batches(spark):
    document = {
        "rows": [
            {"tld": "com", "type": "gTLD", "in_czds": 1, "registry": "V", "status": None},
            {"tld": "net", "type": "gTLD", "in_czds": "", "status": "retired"},
            {"tld": "org", "type": "gTLD", "in_czds": "0"},
            {"tld": 5, "type": "gTLD"},
            {"type": "gTLD"},
            None,
            7,
        ]
    }
    good, bad = batches.row_batches(lines(spark, json.dumps(document)), "tld_dim")
    assert rows(good.select("seq", "tld", "type", "registry", "in_czds", "status")) == [
        (0, "com", "gTLD", "V", True, None), (1, "net", "gTLD", None, False, "retired"), (2, "org", "gTLD", None, True, None),
    ]
    assert [r.seq for r in bad.orderBy("seq").collect()] == [3, 4, 5, 6]


def test_row_batches_number_keys(spark):
    document = {"rows": [{"iana_id": "292", "name": "A"}, {"iana_id": "", "name": "B"}, {"iana_id": None, "name": "C"}, {"iana_id": 7, "name": "D"}]}
    good, bad = batches.row_batches(lines(spark, json.dumps(document)), "registrar_dim")
    assert rows(good.select("iana_id", "name")) == [(292, "A"), (7, "D")]
    assert bad.count() == 2


def test_row_batch_counts(spark):
    row = {"report_month": "2026-01", "iana_id": 1, "tld": "com", "net_adds": "12.7", "renewals": "x", "transfers": True, "deletes": 3}
    good, _ = batches.row_batches(lines(spark, json.dumps({"rows": [row]})), "registrar_monthly_stats")
    stored = prepare(good, POLICIES["registrar_monthly_stats"])
    assert rows(stored.select("net_adds", "renewals", "transfers", "deletes", "domains_under_mgmt")) == [(12, 0, 1, 3, 0)]


def test_tri_state_flags(spark):
    document = {"rows": [{"snap_month": "2026-01", "domain": d, "has_mx": f} for d, f in (("a", None), ("b", 0), ("c", True))]}
    good, _ = batches.row_batches(lines(spark, json.dumps(document)), "monthly_probe")
    assert rows(good.select("domain", "has_mx", "dnssec")) == [("a", None, None), ("b", False, None), ("c", True, None)]


def test_uploads(spark):
    docs = [
        {"date": "2026-01-01", "global": {"domains_tracked_lifetime": 3}, "length_stats": [{"length": 2, "total_possible": 1296, "tracked_count": 3}],
         "length_stats_by_tld": [{"tld": "com", "length": 2, "total_possible": 1296, "tracked_count": 3, "unused_found": 1}, None, {"length": 3, "tracked_count": 1}, {"tld": "net", "tracked_count": 1}]},
        {"date": "2026-01-01", "global": {}, "length_stats": {}},
        {"date": "", "global": {}, "length_stats": []},
        {"global": {}, "length_stats": []},
        {"date": "2026-01-02", "global": {}, "length_stats": [], "word_pos_stats": [{"pos": "noun", "length": 4, "tracked_count": 2}]},
    ]
    parsed = batches.parse_uploads(lines(spark, *map(json.dumps, docs), "not json"))
    assert sorted(r.valid for r in parsed.collect()) == [False] * 4 + [True] * 2
    valid = parsed.filter("valid")
    assert rows(batches.upload_global(valid)) == [("2026-01-01", 3, 0), ("2026-01-02", 0, 0)]
    assert rows(batches.upload_length_rows(valid)) == [("overall", "ALL", 2, 1296, 3, 0, 0), ("overall", "com", 2, 1296, 3, 0, 1)]
    assert rows(batches.upload_word_rows(valid)) == [("overall", "ALL", "noun", 4, 2, 0, 0)]
