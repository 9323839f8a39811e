"""What the plans must not do, and results when one key holds a third of the rows."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from zonetide.functions.fixed import PARTS_OF_SPEECH
from zonetide.operators import aggregates, corpus, dictionary, probes, shares
from zonetide.operators.upsert import POLICIES, fold
from zonetide.plans.registered import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
FORBIDDEN = [
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "InPandas",
    "InArrow",
    "SerializeFromObject",
]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="provided tables not here")
@pytest.mark.parametrize("name", [n for n in REGISTRY if not n.startswith("stream")])
def test_no_products_and_no_python(spark, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if nothing was small enough
    try:
        plan = REGISTRY[name][0](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [f for f in FORBIDDEN if f in plan] == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="provided tables not here")
def test_scans_read_needed_columns(spark):
    plan = REGISTRY["first_wins_dedupe"][0](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_orderstatus" not in plan
    plan = REGISTRY["membership_flags"][0](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "o_orderdate" not in plan


def hot(rng, n, cold):
    """Keys of n rows, a third of which are the same one."""
    return ["hot" if rng.random() < 1 / 3 else f"k{rng.randrange(cold)}" for _ in range(n)]


def test_hot_label(spark):
    rng = random.Random(7)
    data = [(k, rng.random() < 0.5, rng.choice(["no_website", "active_site"]), "words") for k in hot(rng, 3000, 50)]
    probed = spark.createDataFrame(data, "label string, registered boolean, usage_state string, mode string").repartition(9)
    words = [("hot", "noun"), ("hot", "verb"), *[(f"k{i}", rng.choice(PARTS_OF_SPEECH)) for i in range(0, 50, 2)]]
    lists = dictionary.pos_index(spark.createDataFrame(words, "word string, pos string"))
    index = dict(reversed(words))
    expected = {}
    for label, registered, usage, _ in data:
        if label in index:
            cell = expected.setdefault((index[label], len(label)), [0, 0, 0])
            cell[0] += 1
            cell[1] += not registered
            cell[2] += registered and usage == "no_website"
    assert rows(aggregates.word_pos_stats(probed, lists)) == sorted(((*k, *v) for k, v in expected.items()), key=repr)


def test_hot_key_in_ledger_and_first_wins(spark):
    rng = random.Random(8)
    data = [("2026-01", k, rng.choice([None, "x", "y"]), i) for i, k in enumerate(hot(rng, 3000, 200))]
    df = spark.createDataFrame(data, "snap_month string, domain string, ns_provider string, seq bigint").repartition(9)
    last, first = {}, {}
    for month, domain, provider, seq in data:
        last[domain] = (month, domain, provider)
        first.setdefault(domain, (month, domain, provider, seq))
    assert rows(fold(df, POLICIES["monthly_probe"])) == sorted(last.values(), key=repr)
    assert rows(corpus.first_wins(df, ["domain"], ["seq"])) == sorted(first.values(), key=repr)


def test_hot_name_in_answers(spark):
    rng = random.Random(9)
    data = [(k, i, rng.random() < 0.6, rng.random() < 0.5) for i, k in enumerate(hot(rng, 3000, 300))]
    verdicts = spark.createDataFrame(data, "domain string, attempt int, resolver_error boolean, registered boolean").repartition(9)
    expected = {}
    for domain, _, error, registered in data:
        if domain not in expected or expected[domain][2]:
            expected[domain] = (domain, registered if not error else False, error)
    assert rows(probes.resolve(verdicts)) == sorted(expected.values(), key=repr)


def test_hot_provider(spark):
    rng = random.Random(10)
    data = [(f"d{i}", k, rng.choice([["all"], ["sp500", "all"]])) for i, k in enumerate(hot(rng, 3000, 20))]
    df = spark.createDataFrame(data, "domain string, analytics_provider string, tiers array<string>").withColumn("snap_month", F.lit("2026-01"))
    counted, totals = Counter(), Counter()
    for _, key, tiers in data:
        for tier in tiers:
            counted[(tier, key)] += 1
            totals[tier] += 1
    found = {(r.tier, r.provider_key): (r["count"], r.total) for r in shares.provider_share(df).collect()}
    assert found == {k: (n, totals[k[0]]) for k, n in counted.items()}
