from __future__ import annotations

import random

from conftest import rows

from zonetide.operators import zones
from zonetide.plans import zone_store

NAMES = "snap_date string, tld string, domain string"


def _days(rng):
    out = []
    for tld, days in (("com", range(1, 7)), ("de", (1, 3, 6)), ("org", (2,)), ("net", (4, 5))):
        held = {f"{tld}{k}" for k in range(300)}
        for day in days:
            held = {n for n in held if rng.random() > 0.01} | {f"{tld}-{day}-{k}" for k in range(rng.randrange(4))}
            out += [(f"2026-01-{day:02d}", tld, name) for name in held]
    return out


def test_history_equals_the_join_of_all_names(spark, tmp_path):
    days = _days(random.Random(3))
    df = spark.createDataFrame(days + days[:50], NAMES)
    zone_store.store_snapshots(df, str(tmp_path / "z"), buckets=4, leaves=16)
    want = rows(zones.zone_history(df).select("snap_date", "tld", "registered_total", "new_today", "dropped_today"))
    assert rows(zone_store.zone_history(spark, str(tmp_path / "z"))) == want
    some = ["2026-01-03", "2026-01-06"]
    assert rows(zone_store.zone_history(spark, str(tmp_path / "z"), some)) == [r for r in want if r[0] in some]


def test_days_arrive_one_by_one_and_again(spark, tmp_path):
    days = _days(random.Random(4))
    df = spark.createDataFrame(days, NAMES)
    for day in sorted({d for d, _, _ in days}):
        zone_store.store_snapshots(df.filter(df.snap_date == day), str(tmp_path / "z"), 4, 16)
    wrong = spark.createDataFrame([("2026-01-04", "com", "only")], NAMES)
    zone_store.store_snapshots(wrong, str(tmp_path / "w"), 4, 16)
    zone_store.store_snapshots(df, str(tmp_path / "w"), 4, 16)  # replaces the day
    want = rows(zones.zone_history(df).select("snap_date", "tld", "registered_total", "new_today", "dropped_today"))
    for home in ("z", "w"):
        assert rows(zone_store.zone_history(spark, str(tmp_path / home))) == want


def test_only_what_differs_is_read(spark, tmp_path):
    first = [("2026-01-01", "com", f"n{k}") for k in range(4000)]
    path = str(tmp_path / "z")
    zone_store.store_snapshots(spark.createDataFrame(first + [("2025-12-01", "com", "old")], NAMES), path, 8, 256)
    placed = {r.domain: (r.bucket, r.leaf) for r in zone_store._names(spark, path).filter("snap_date = '2026-01-01'").collect()}
    gone = {name for name, (bucket, _) in placed.items() if bucket in (2, 5)}
    gone = set(sorted(gone)[:20])
    second = [("2026-01-02", "com", name) for _, _, name in first if name not in gone]
    zone_store.store_snapshots(spark.createDataFrame(second, NAMES), path, 8, 256)
    moved = zone_store.changed_names(spark, path, ["2026-01-02"])
    assert rows(moved.select("domain", "now")) == sorted([(n, False) for n in gone], key=repr)
    plan = moved._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "domain" in line]
    buckets = sorted({placed[n][0] for n in gone})
    assert scans and all(f"bucket#" in s and f"IN ({','.join(map(str, buckets))})" in s and "2025-12-01" not in s for s in scans)
    # the names that are joined are those of leaves that differ
    leaves = {placed[n] for n in gone}
    joined = [n for n, at in placed.items() if at in leaves]
    assert len(joined) < 100
    # an unchanged day has nothing to read at all
    zone_store.store_snapshots(spark.createDataFrame([("2026-01-03", t, d) for _, t, d in second], NAMES), path, 8, 256)
    assert zone_store.changed_names(spark, path, ["2026-01-03"]).count() == 0
    assert rows(zone_store.zone_history(spark, path, ["2026-01-03"])) == [("2026-01-03", "com", 3980, 0, 0)]
