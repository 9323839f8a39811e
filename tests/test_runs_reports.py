from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from zonetide.operators import aggregates, runs
from zonetide.operators.upsert import POLICIES
from zonetide.plans import ledger, reports

EVENT = "seq bigint, ts string, run_id string, event string, status string, domains_processed string, errors_count string, source string, notes string"


def event(seq, run, kind, status=None, domains=None, notes=None):
    return (seq, f"2026-01-01 00:{seq:02d}:00", run, kind, status, domains, None, "local", notes)


def folded(spark, *events):
    return runs.fold_runs(runs.clean_events(spark.createDataFrame(list(events), EVENT)))


def test_lifecycle(spark):
    log = folded(
        spark,
        event(1, "r", "start", notes="one"),
        event(2, "r", "start", notes="two"),
        event(3, "r", "heartbeat", domains="5"),
        event(4, "r", "finish", "failed", "9"),
        event(5, "r", "heartbeat", domains="3"),
        event(6, "ghost", "finish", "success", "1"),
        event(7, "late", "heartbeat", domains="8"),
        event(8, "late", "start"),
        event(9, "odd", "start"),
        event(10, "odd", "finish", "exploded", "NaN", "said why"),
        event(11, "", "start"),
        event(12, "x", "stop"),
    )
    picked = log.select("run_id", "finished_at", "status", "domains_processed", "notes")
    assert rows(picked) == [
        ("late", None, "running", 0, None),
        ("odd", "2026-01-01 00:10:00", "success", 0, "said why"),
        ("r", "2026-01-01 00:04:00", "failed", 3, "one"),
    ]
    assert runs.latest_run(log).head().run_id == "odd"


def test_run_summary(spark):
    blocks = spark.createDataFrame(
        [("a", 25, True, False), ("a", 30, True, False), ("b", 5, False, False), ("c", 5, True, True)],
        "run_id string, domains int, uploaded boolean, timed_out boolean",
    )
    assert rows(aggregates.run_summary(blocks)) == [("a", 2, 55, 0, False, "success"), ("b", 1, 5, 1, False, "partial"), ("c", 1, 5, 0, True, "partial")]


RUNS = "run_id string, started_at string, finished_at string, status string"
STATS = "date string, domains_tracked_lifetime bigint, domains_tracked_24h bigint, updated_at string"
LENGTHS = "snap_date string, tld string, length bigint, total_possible bigint, tracked_count bigint, unregistered_found bigint, unused_found bigint"
WORDS = "snap_date string, tld string, pos string, length bigint, tracked_count bigint, unregistered_found bigint, unused_found bigint"
NOW = "2026-05-02 12:00:00"


@pytest.mark.parametrize(
    "run, updated, messages, ok",
    [
        (None, None, ["no aggregate data", "no runs recorded yet"], False),
        (("r", "2026-05-01 00:00:00", "2026-05-02 11:00:00", "success"), "2026-05-02 11:00:00", ["ok: 1h since last upload", "ok: 1h since last success run"], True),
        (("r", "2026-05-02 11:00:00", None, "running"), "2026-05-02 11:00:00", ["ok: 1h since last upload", "ok: 1h since last running run"], True),
        (("r", "x", "2026-05-02 11:00:00", "failed"), "2026-05-01 05:30:00", ["stale: 31h since last upload (threshold 30h)", "last run status=failed (run_id=r)"], False),
        (("r", "x", "2026-05-01 05:30:00", "failed"), "2026-05-01 05:31:00", ["ok: 30h since last upload", "stale: 31h since last run (threshold 30h)"], False),
        (("r", "x", "soon", "success"), "2026-05-02 11:00:00", ["ok: 1h since last upload", "stale: nullh since last run (threshold 30h)"], False),
    ],
)
def test_freshness(spark, run, updated, messages, ok):
    log = spark.createDataFrame([run] if run else [], RUNS)
    stats = spark.createDataFrame([("2026-05-01", 1, 1, updated)] if updated else [], STATS)
    checks = reports.freshness(log, stats, NOW)
    assert [r.message for r in checks.orderBy("name").collect()] == messages
    assert rows(reports.health(checks)) == [(ok, "ok" if ok else "degraded")]


def test_overview(spark):
    stats = spark.createDataFrame([("2026-05-01", 10, 10, "a"), ("2026-05-02", 4, 4, "b")], STATS)
    lengths = spark.createDataFrame([("overall", "ALL", 2, 1296, 9, 1, 2), ("overall", "com", 2, 1296, 9, 1, 2), ("2026-05-01", "ALL", 3, 1, 1, 1, 1)], LENGTHS)
    words = spark.createDataFrame([("overall", "ALL", "noun", 4, 3, 1, 0), ("overall", "com", "noun", 4, 3, 1, 0)], WORDS)
    log = spark.createDataFrame([("r", "s", "f", "success")], RUNS)
    found = reports.overview(stats, lengths, words, log)
    assert rows(found.totals) == [(14, 4, "b", "f", "success")]
    assert rows(found.lengths) == [(2, 1296, 9, 1, 2)]
    assert rows(found.tld_lengths) == [("com", 2, 1296, 9, 1, 2)]
    assert rows(found.words) == [("noun", 4, 3, 1, 0)]
    no_runs = reports.overview(stats, lengths, words, log.limit(0))
    assert rows(no_runs.totals) == [(14, 4, "b", "b", None)]
    empty = reports.overview(stats.limit(0), lengths, words, log)
    assert rows(empty.totals) == [(0, 0, None, "f", "success")]
    assert empty.lengths.count() == empty.tld_lengths.count() == empty.words.count() == 0


def test_latest_month_reads_one_partition(spark, tmp_path):
    policy = POLICIES["provider_share_monthly"]
    path = str(tmp_path / "shares")
    january, february = (
        spark.createDataFrame([(m, "all", "ns", "x", n, 10, n / 10, None, None)], SHARES) for m, n in (("2026-01", 3), ("2026-02", 4))
    )
    ledger.store_by_month(january.unionByName(february), path)
    ledger.store_by_month(january.withColumn("count", F.lit(9).cast("bigint")), path)
    stored = ledger.read_by_month(spark, path, policy)
    assert rows(stored.select("snap_month", "count")) == [("2026-01", 9), ("2026-02", 4)]
    latest = reports.provider_latest(stored)
    assert rows(latest.select("snap_month", "count")) == [("2026-02", 4)]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snap_month" in plan and "subquery" in plan.lower()


SHARES = "snap_month string, tier string, category string, provider_key string, count bigint, total bigint, share double, delta_count bigint, delta_share double"


def test_provider_reports(spark):
    shares = spark.createDataFrame(
        [(m, t, "ns", p, n, 10, n / 10, None, None) for m in ("2025-02", "2025-03", "2026-03") for t in ("all", "sp500") for p, n in (("x", 3), ("y", 7))],
        SHARES,
    )
    latest = reports.provider_latest(shares)
    assert [(r.tier, r.provider_key) for r in latest.collect()] == [("all", "y"), ("all", "x"), ("sp500", "y"), ("sp500", "x")]
    assert {r.snap_month for r in latest.collect()} == {"2026-03"}
    assert reports.provider_latest(shares, "all", "mx").count() == 0
    assert reports.provider_latest(shares.limit(0)).count() == 0
    history = reports.provider_history(shares, "all", "ns", now="2026-03-31")
    assert [(r.snap_month, r.provider_key) for r in history.collect()] == [("2025-03", "y"), ("2025-03", "x"), ("2026-03", "y"), ("2026-03", "x")]
    assert reports.provider_history(shares, "all", "ns", months=-5, now="2026-03-31").count() == 0
    with pytest.raises(ValueError):
        reports.provider_history(shares, "", "ns")
