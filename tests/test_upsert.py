from __future__ import annotations

import random

import pytest
from conftest import rows

from zonetide.operators.upsert import POLICIES, fold, prepare, upsert
from zonetide.plans import ledger

TLD = "tld string, type string, registry string, in_czds boolean, status string, seq bigint"


def test_kept_and_overwritten_columns(spark):
    policy = POLICIES["tld_dim"]
    current = spark.createDataFrame([("com", "gTLD", "A", True, "retired")], "tld string, type string, registry string, in_czds boolean, status string")
    batch = spark.createDataFrame([("com", "sTLD", None, None, None, 0)], TLD)
    assert rows(upsert(current, batch, policy)) == [("com", "sTLD", "A", False, "active")]


def test_missing_flag_clears_it(spark):
    policy = POLICIES["companies"]
    current = spark.createDataFrame([("n", "a.com", "T", True)], "name string, canonical_domain string, ticker string, in_sp500 boolean")
    batch = spark.createDataFrame([("m", "A.com", None, None, 0)], "name string, canonical_domain string, ticker string, in_sp500 boolean, seq int")
    assert rows(upsert(current, batch, policy)) == [("m", "a.com", "T", False)]


def test_probe_nulls_overwrite(spark):
    policy = POLICIES["monthly_probe"]
    batch = spark.createDataFrame(
        [("2026-01", "a.com", "x", None, 0), ("2026-01", "A.com", None, True, 1)],
        "snap_month string, domain string, ns_provider string, has_mx boolean, seq int",
    )
    assert rows(fold(prepare(batch, policy), policy)) == [("2026-01", "a.com", None, True)]


def test_last_row_of_a_batch_wins(spark):
    policy = POLICIES["tranco_ranks"]
    batch = spark.createDataFrame([("a.com", "2026-01", 5, 1), ("A.COM", "2026-01", 3, 2), ("a.com", "2026-02", 9, 0)], "domain string, snap_month string, rank bigint, seq int")
    assert rows(fold(prepare(batch, policy), policy)) == [("a.com", "2026-01", 3), ("a.com", "2026-02", 9)]


LENGTH = "snap_date string, tld string, length bigint, total_possible bigint, tracked_count bigint, unregistered_found bigint, unused_found bigint, seq bigint"


def _length_rows(rng, n, start):
    return [("overall", rng.choice(["ALL", "com"]), rng.randrange(1, 4), 36, rng.randrange(9), rng.randrange(9), rng.randrange(9), start + i) for i in range(n)]


def test_additive_folds_commute(spark):
    rng = random.Random(3)
    first, second = (spark.createDataFrame(_length_rows(rng, 40, s), LENGTH) for s in (0, 40))
    policy = POLICIES["length_stats"]
    one_way = upsert(fold(first, policy), second, policy)
    assert rows(one_way) == rows(upsert(fold(second, policy), first, policy)) == rows(fold(first.unionByName(second), policy))


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_row_by_row_upserts(spark, seed):
    rng = random.Random(seed)
    policy = POLICIES["tld_dim"]
    pick = lambda *v: rng.choice(v)
    batch = [(pick("a", "b", "c"), pick("g", "s"), pick(None, "R", "S"), pick(None, True, False), pick(None, "retired"), i) for i in range(60)]
    table = {}
    for tld, kind, registry, flag, status, _ in batch:
        old = table.get(tld, (None,) * 5)
        table[tld] = (tld, kind, registry or old[2], bool(flag), status or "active")
    df = spark.createDataFrame(batch, TLD).repartition(5)
    assert rows(fold(prepare(df, policy), policy)) == sorted(table.values(), key=repr)


def test_every_policy_covers_its_table():
    for name, policy in POLICIES.items():
        columns = {*policy.keys, *policy.add, *policy.overwrite, *policy.keep}
        assert columns == set(policy.schema.fieldNames()), name


def test_ledger_round_trip(spark, tmp_path):
    policy = POLICIES["length_stats"]
    rng = random.Random(5)
    path, smaller = str(tmp_path / "l"), str(tmp_path / "c")
    parts = [spark.createDataFrame(_length_rows(rng, 30, 0), LENGTH) for _ in range(3)]
    for epoch, part in enumerate(parts):
        ledger.append(part, path, epoch)
    before = rows(ledger.table(ledger.read(spark, path), policy))
    ledger.append(parts[2], path, 2)  # a retry of the same epoch
    assert rows(ledger.table(ledger.read(spark, path), policy)) == before
    ledger.compact(spark, path, policy, smaller)
    assert rows(ledger.table(ledger.read(spark, smaller), policy)) == before
    ledger.append(parts[0], smaller, 3)
    ledger.append(parts[0], path, 3)
    assert rows(ledger.table(ledger.read(spark, smaller), policy)) == rows(ledger.table(ledger.read(spark, path), policy))
