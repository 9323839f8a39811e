from __future__ import annotations

import hashlib
import math
import random

import pytest
from conftest import rows

from zonetide.operators import attribution

NAMES = "tld string, month string, domain string"


def _names(rng, sizes):
    return [(tld, month, f"n{rng.randrange(10**9)}.{tld}") for (tld, month), n in sizes.items() for _ in range(n)]


def _expected(names, k):
    groups = {}
    for tld, month, domain in set(names):
        groups.setdefault((tld, month), []).append((int(hashlib.md5(domain.encode()).hexdigest()[:12], 16), domain))
    return sorted(((t, m, d, p) for (t, m), found in groups.items() for p, d in sorted(found)[: k + 1]), key=repr)


def test_sample_is_the_lowest_priorities_and_merges(spark):
    names = _names(random.Random(1), {("com", "2026-01"): 3000, ("com", "2026-02"): 21, ("de", "2026-01"): 20, ("org", "2026-01"): 1})
    df = spark.createDataFrame(names + names[:500] + [("com", "2026-01", None)], NAMES)
    whole = rows(attribution.bottom_k(df, 20))
    assert whole == _expected(names, 20)
    parts = [attribution.bottom_k(spark.createDataFrame(names[i::3] + names[:40], NAMES), 20) for i in range(3)]
    assert rows(attribution.merge(parts, 20)) == whole
    assert rows(attribution.merge([parts[2], attribution.merge(parts[:2], 20)], 20)) == whole
    assert rows(attribution.bottom_k(df.limit(0), 20)) == []


def test_small_groups_are_exact(spark):
    names = _names(random.Random(2), {("com", "2026-01"): 20, ("de", "2026-01"): 7})
    kept = attribution.weighted(attribution.bottom_k(spark.createDataFrame(names, NAMES), 20), 20)
    assert rows(attribution.estimates(kept)) == [("com", "2026-01", 20, 20.0, 0.0), ("de", "2026-01", 7, 7.0, 0.0)]


def test_estimates_within_the_stated_error(spark):
    rng = random.Random(3)
    names = _names(rng, {("com", f"2026-{m:02d}"): 5000 for m in range(1, 13)})
    shares = {"a": 0.6, "b": 0.3, "c": 0.1}
    owner = {d: rng.choices(list(shares), list(shares.values()))[0] for _, _, d in names}
    registrars = spark.createDataFrame(list(owner.items()), "domain string, registrar string")
    kept = attribution.weighted(attribution.bottom_k(spark.createDataFrame(names, NAMES), 300), 300)
    found = attribution.estimates(kept.join(registrars, "domain"), "registrar").collect()
    misses, squares = 0, []
    for r in found:
        true = len({d for _, m, d in names if m == r.month and owner[d] == r.registrar})
        z = (r.estimate - true) / r.error
        misses += abs(z) > 2
        squares.append(z * z)
    assert len(found) == 36 and misses <= 5
    assert 0.5 < sum(squares) / len(squares) < 1.7  # the stated error is the one made
    totals = attribution.estimates(kept).collect()
    assert all(r.error == pytest.approx(math.sqrt(300) / (300 / r.estimate), rel=0.1) for r in totals)


def test_a_hot_group_is_cut_before_it_meets(spark):
    names = spark.range(200000).selectExpr("'com' AS tld", "'2026-01' AS month", "concat('n', id) AS domain")
    plan = attribution.bottom_k(names, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
