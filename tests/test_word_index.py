from __future__ import annotations

import random
import re

import pytest

from zonetide.operators import candidates
from zonetide.plans import word_index

TLDS = ["com", "net", "org"]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(500)})
    path = str(tmp_path_factory.mktemp("words"))
    word_index.store_words(spark.createDataFrame([(w,) for w in words + words[:50]], "word string").repartition(3), path, 40)
    return words, path


@pytest.mark.parametrize("cursor, n", [(0, 10), (17, 100), (1230, 1), (-5, 12), (0, 0), (700, 5000), (10**12 + 7, 150)])
def test_batches_from_any_cursor(spark, store, cursor, n):
    words, path = store
    want = [(p, f"{words[p // 3 % len(words)]}.{TLDS[p % 3]}") for p in range(cursor, cursor + n)]
    got = word_index.batch(spark, path, cursor, n, TLDS)
    assert [tuple(r) for r in got.select("pair", "domain").orderBy("pair").collect()] == want
    whole = spark.createDataFrame(list(enumerate(words)), "pos bigint, word string")
    assert sorted(map(tuple, candidates.word_batch(whole, cursor, n, TLDS).collect())) == sorted(map(tuple, got.collect()))


def test_only_its_sections_are_read(spark, store):
    words, path = store
    last = (len(words) - 1) // 40
    for cursor in range(0, 3 * len(words), 91):
        runs = word_index.sections_of(cursor, 60, 3, len(words), 40)
        touched = {s for low, high in runs for s in range(low, high + 1)}
        assert touched == {p // 3 % len(words) // 40 for p in range(cursor, cursor + 60)} and len(touched) <= 3
    assert word_index.sections_of(0, 10**9, 3, len(words), 40) == [(0, last)] and word_index.sections_of(5, 10, 3, 0, 40) == []
    plan = word_index.batch(spark, path, 300, 60, TLDS)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*section#\d+L >= 2[^\]]*section#\d+L <= 2", plan), plan


def test_no_words(spark, tmp_path):
    word_index.store_words(spark.createDataFrame([], "word string"), str(tmp_path / "w"))
    assert word_index.batch(spark, str(tmp_path / "w"), 0, 10).count() == 0
