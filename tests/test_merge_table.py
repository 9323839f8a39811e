from __future__ import annotations

import os
import random

import pytest
from conftest import rows

from zonetide.operators.upsert import POLICIES, fold, prepare
from zonetide.plans import merge_table

TLD = "tld string, type string, registry string, in_czds boolean, status string, seq bigint"
LENGTHS = "snap_date string, tld string, length bigint, total_possible bigint, tracked_count bigint, unregistered_found bigint, unused_found bigint, seq bigint"


@pytest.fixture
def stored(spark, tmp_path):
    made = []

    def make(policy, columns=None):
        name = f"t{os.path.basename(tmp_path)}_{len(made)}".replace("-", "_")
        merge_table.create(spark, name, policy, str(tmp_path / name), columns)
        made.append(name)
        return name

    yield make
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_batches_give_what_one_fold_gives(spark, stored):
    rng = random.Random(2)
    for table, schema, row in (
        ("tld_dim", TLD, lambda: (rng.choice(["com", "de", "org", None] + [f"t{k}" for k in range(40)]), rng.choice(["a", "b"]), rng.choice([None, "r1", "r2"]), rng.choice([None, True, False]), rng.choice([None, "gone"]))),
        ("length_stats", LENGTHS, lambda: ("overall", rng.choice(["ALL", "com"]), rng.randrange(30), rng.randrange(99), *[rng.choice([None, rng.randrange(9)]) for _ in range(3)])),
    ):
        policy = POLICIES[table]
        name = stored(policy, [c.split()[0] for c in schema.split(", ")])
        everything = []
        for step in range(4):
            batch = [(*row(), step * 1000 + k) for k in range(60)]
            everything += batch
            merge_table.merge(spark, name, spark.createDataFrame(batch, schema).repartition(3), policy)
        keys = [schema.split(", ").index(next(c for c in schema.split(", ") if c.startswith(k + " "))) for k in policy.keys]
        valid = [r for r in everything if all(r[k] is not None for k in keys)]
        whole = fold(prepare(spark.createDataFrame(valid, schema), policy), policy)
        assert rows(merge_table.rows(spark, name).select(*whole.columns)) == rows(whole)
        times = spark.table(name).select("updated_at").collect()
        assert all(r.updated_at is not None for r in times)


def test_a_merge_touches_its_parts_and_leaves_the_stored_side_in_place(spark, stored, tmp_path):
    policy = POLICIES["tld_dim"]
    name = stored(policy)
    merge_table.merge(spark, name, spark.createDataFrame([(f"t{k}", "x", None, None, None, k) for k in range(400)], TLD), policy)
    files = {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(tmp_path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}
    one = spark.createDataFrame([("t7", "y", "R", True, None, 0)], TLD)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        plan = merge_table.merged(spark.table(name), one, policy)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    left, right = plan.split("SortMergeJoin", 1)[1].split("Bucketed: true")
    assert "Exchange" not in left and "Exchange" in right
    parts = merge_table.merge(spark, name, one, policy)
    assert len(parts) == 1
    later = {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(tmp_path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}
    assert {f for f in files if f"_part={parts[0]}/" not in f} == {f for f in later if f"_part={parts[0]}/" not in f}
    assert not {f for f in files if f"_part={parts[0]}/" in f} & set(later)
    found = {r.tld: (r.type, r.registry, r.in_czds) for r in merge_table.rows(spark, name).collect()}
    assert found["t7"] == ("y", "R", True) and len(found) == 400 and found["t8"] == ("x", None, False)


def test_nothing_to_merge(spark, stored):
    policy = POLICIES["tld_dim"]
    name = stored(policy)
    empty = spark.createDataFrame([], TLD)
    assert merge_table.merge(spark, name, empty, policy) == [] and merge_table.rows(spark, name).count() == 0
    merge_table.merge(spark, name, spark.createDataFrame([(None, "x", None, None, None, 1), ("a", "x", None, None, None, 1)], TLD), policy)
    assert [r.tld for r in merge_table.rows(spark, name).collect()] == ["a"]


def test_a_table_is_opened_again(spark, stored, tmp_path):
    policy = POLICIES["tld_dim"]
    name = stored(policy)
    merge_table.merge(spark, name, spark.createDataFrame([("a", "x", None, None, None, 1)], TLD), policy)
    spark.sql(f"DROP TABLE {name}")
    merge_table.create(spark, name, policy, str(tmp_path / name))
    merge_table.merge(spark, name, spark.createDataFrame([("a", "y", None, None, None, 1), ("b", "x", None, None, None, 1)], TLD), policy)
    assert rows(merge_table.rows(spark, name).select("tld", "type")) == [("a", "y"), ("b", "x")]
