from __future__ import annotations

import itertools
import random

import pytest
from conftest import rows

from zonetide.functions.fixed import LABEL_ALPHABET
from zonetide.operators import candidates
from zonetide.operators.positions import with_position


def labels(length):
    return ["".join(t) for t in itertools.product(LABEL_ALPHABET, repeat=length)]


def test_scan_order(spark):
    tlds = ["com", "net"]
    whole = [f"{label}.{t}" for n in (1, 2) for t in tlds for label in labels(n)]
    found = candidates.enumerate_batch(spark, 1, 0, 0, len(whole), tlds).orderBy("ordinal").collect()
    assert [r.domain for r in found] == whole


def test_scan_from_a_cursor_and_past_the_end(spark):
    found = candidates.enumerate_batch(spark, 2, 1, 1295, 3, ["com", "net"]).orderBy("ordinal").collect()
    assert [r.domain for r in found] == ["99.net", "aaa.com", "aab.com"]
    last = candidates.enumerate_batch(spark, 10, 13, 36**10 - 2, 5).orderBy("ordinal").collect()
    assert [r.domain for r in last] == ["9999999998.me", "9999999999.me"]


def taken(cursors, n):
    """The first n of all open (index, TLD position) slots, per length."""
    out = []
    for length in {c[0] for c in cursors}:
        slots = [(i, pos, tld) for l, tld, pos, nxt in cursors if l == length for i in range(nxt, min(nxt + n, 36**length))]
        out += [(length, tld, pos, i) for i, pos, tld in sorted(slots)[:n]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_fair_batch_takes_the_lowest_slots(spark, seed):
    rng = random.Random(seed)
    cursors = [(length, f"t{p}", p, rng.choice([0, 3, 30, 36, 40, rng.randrange(1400)])) for length in (1, 2) for p in range(5)]
    n = rng.choice([1, 7, 64, 500, 20000])
    df = spark.createDataFrame(cursors, "length int, tld string, tld_pos int, next_index bigint")
    batch = candidates.fair_batch(df, n)
    assert rows(batch.select("length", "tld", "tld_pos", "idx")) == taken(cursors, n)


def test_fair_batch_in_chunks(spark):
    df = spark.createDataFrame([(4, "com", 0, 5), (4, "net", 1, 0)], "length int, tld string, tld_pos int, next_index bigint")
    batch = candidates.fair_batch(df, 50_001)
    counts = {r.tld: (r["count"], r["max(idx)"]) for r in batch.groupBy("tld").agg({"*": "count", "idx": "max"}).withColumnRenamed("count(1)", "count").collect()}
    assert counts == {"com": (24998, 25002), "net": (25003, 25002)}


def test_cursor_cycle(spark):
    tlds = spark.createDataFrame([("com", 0), ("new", 1)], "tld string, tld_pos int")
    stored = spark.createDataFrame([(1, "com", 30), (1, "gone", 5)], "length int, tld string, next_index bigint")
    cursors = candidates.sync_cursors(stored, tlds, [1, 2])
    assert rows(cursors.select("length", "tld", "next_index")) == [(1, "com", 30), (1, "new", 0), (2, "com", 0), (2, "new", 0)]
    lag = candidates.cursor_lag(cursors)
    assert rows(lag) == [(1, "new", 0, 15.0, 15.0)]
    moved = candidates.advance_cursors(cursors, candidates.fair_batch(cursors, 40))
    assert rows(moved.select("length", "tld", "next_index")) == [(1, "com", 35), (1, "new", 35), (2, "com", 20), (2, "new", 20)]
    done = candidates.advance_cursors(moved, candidates.fair_batch(moved, 40))
    assert rows(candidates.exhausted_lengths(done)) == [(1, True), (2, False)]


def test_positions(spark):
    words = [(f"w{i:05d}",) for i in range(5000)]
    random.Random(1).shuffle(words)
    placed = with_position(spark.createDataFrame(words, "word string").repartition(7), "word")
    assert rows(placed.select("pos", "word")) == rows(spark.createDataFrame([(i, f"w{i:05d}") for i in range(5000)], "pos int, word string"))


def test_word_batch_wraps(spark):
    words = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos bigint, word string")
    found = candidates.word_batch(words, 3, 7, ["com", "net"]).orderBy("pair").collect()
    assert [r.domain for r in found] == ["b.net", "c.com", "c.net", "a.com", "a.net", "b.com", "b.net"]
    assert candidates.word_batch(words.limit(0), 0, 5, ["com"]).count() == 0
