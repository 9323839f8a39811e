"""Repeated ids, bounded samples, broken pages and clashing columns."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from zonetide.llm import bpe, html_text, jaccard
from zonetide.llm.labelled import labelled_sample

SF_DIR = "/root/testdata/sf0.001"
A, B = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")


def _kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, mark int")
    return sorted(map(tuple, jaccard.kept_rows(df).collect()), key=repr)


def test_near_duplicates_with_repeated_ids(spark):
    assert _kept(spark, [(5, A, "x", 1), (5, B, "y", 2), (3, B, "z", 3)]) == [(3, B, "z", 3), (5, A, "x", 1)]
    assert _kept(spark, [(5, A, "x", 1), (5, A, "w", 2)]) == [(5, A, "w", 2)]
    assert _kept(spark, [(None, A, "x", 1), (4, A, "y", 2)]) == [(4, A, "y", 2)]
    assert _kept(spark, [(None, A, "x", 1), (None, A + " end", "y", 2)]).__len__() == 1
    alone = [(1, None, "x", 1), (1, None, "x", 1), (2, "", "y", 2), (None, " ", "z", 3)]
    assert _kept(spark, alone) == sorted(alone, key=repr)
    hot = [(7, A, "x", 1)] * 50 + [(8, A + " more", "y", 2)] * 50 + [(9, B, "z", 3)]
    assert _kept(spark, hot) == [(7, A, "x", 1), (9, B, "z", 3)]
    assert _kept(spark, [(1, A, "x", 1)] * 0) == []


def test_text_hash_is_sparks(spark):
    texts = ["", "a", "é" * 100, "x" * 1000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert {r.i: r.h for r in df.select("i", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("h")).collect()} == {i: jaccard.text_hash(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates, corpus_pipeline.decontaminated, corpus_pipeline.pseudonyms])
def test_stages_hand_on_any_columns(spark, stage):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = {c: F.lit(f"own {c}") for c in ("kept", "contaminated", "_stats", "items", "component_id", "_rest", "n_words", "mark")}
    plain = {r.doc_id: r.text for r in stage(spark, docs, SF_DIR).collect()}
    out = stage(spark, docs.withColumns(extra), SF_DIR)
    assert out.columns == [*docs.columns, *extra]
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == plain and all(r[c] == f"own {c}" for r in rows for c in extra)
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_sample_is_bounded_by_rows(spark):
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.text for r in labelled_sample(docs, labels, "toxic", {0: 1, 1: 1}).collect()] == ["t0"]


# ---- pages -----------------------------------------------------------------


def _texts(page):
    return [t for t in html_text.parse(page).text if t]


def test_broken_markup_is_no_text():
    assert _texts("<p>a<![foo[x]]>b</p>") == ["a", "b"] and _texts("<![ x>") == []
    for tail in ("<!-- x", "<?php x", "<!doc", '<div class="', "</sec", "<![CDATA[ x"):
        assert _texts("<p>one</p>" + tail) == ["one"]
    assert "".join(_texts("a < b &amp; c")) == "a < b & c"


def test_mutated_pages_are_parsed():
    rng = random.Random(9)
    parts = ["<p>", "</p>", "<div>", "</div>", "<![", "]]>", "<!--", "-->", "<?", "<!", ">", "<", "&#xD800;", "&", "<script>", "</script>", "<li>", "<ul>", "</ul>", "<b", "'", '"', "=", "text ", "é", "\x00", "<table><tr><td>", "</i>", "<title>"]
    for _ in range(10_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        tree = html_text.parse(page)
        assert len({*map(len, (tree.parent, tree.tag, tree.text, tree.hidden))}) == 1 and all(up < i for i, up in enumerate(tree.parent))


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</p>" * 60_000, "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000, "<li>" * 30_000 + "<ul>" * 30_000 + "<li>" * 30_000])
def test_parsing_takes_time_in_proportion(page):
    start = time.process_time()
    html_text.parse(page)
    assert time.process_time() - start < 5


# ---- merging together ------------------------------------------------------


def _plain_merge(piece, ranks):
    """One pair at a time: the lowest rank, the leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    tokens = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[t] for t in tokens]
        _, i = min(pairs)
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


def test_merging_together_is_merging_one_by_one():
    rng = random.Random(6)
    for trial in range(150):
        # any ranks, so merges often make pairs of lower ranks than their own
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(0, 40))}
        order = [*tokens]
        rng.shuffle(order)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(order)}
        merges = bpe.Merges(ranks)
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(40)]
        ids, offsets = bpe.merge_all(pieces, merges)
        for i, piece in enumerate(pieces):
            if piece not in ranks:
                assert ids[offsets[i] : offsets[i + 1]].tolist() == _plain_merge(piece, ranks) == bpe.merge(piece, merges)
