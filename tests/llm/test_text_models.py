"""BPE, quality rules, token counts, toxicity and HTML extraction."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from zonetide.llm import bpe, html_text, quality, token_counts, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "don't  stop\n now", "aaaa" * 3000, "漢字 éß  x", "a \n b\t\r\n", "Ünï 123's !!", "same", "same", "\x1c\x00 z"]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.parse_ranks(open(PATH, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes(spark, reference):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'s", "é", "漢", "1", "\t", "don't", "the", "ing", "!", ",", "ZZ"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "_coded": F.lit(1)})
    for row in bpe.tokenize(df, PATH, public_tokenizers.PATTERN, decoded="decoded").collect():
        text = texts[row.doc_id] or ""
        assert row.ids == reference.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    tokenizer = bpe.Tokenizer(df, PATH, public_tokenizers.PATTERN)
    arrays = spark.createDataFrame([(1, None), (2, []), (3, reference.encode_ordinary("a bé"))], "k int, ids array<int>")
    assert [bytes(r.b) for r in arrays.select("k", tokenizer.decode(F.col("ids")).alias("b")).orderBy("k").collect()] == [b"", b"", "a bé".encode()]
    assert bpe.tokenize(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_come_in_parts(reference, monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 40)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["ab", " ", "  ", " \n", "é漢", "'s", " the"]) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    encoder = bpe.Encoder(bpe.parse_ranks(open(PATH, "rb").read()), public_tokenizers.PATTERN)
    parts = list(encoder.encode_parts(pa.array(texts)))
    assert [np.frombuffer(ids, "<i4").tolist() for part in parts for ids in part] == [reference.encode_ordinary(t or "") for t in texts]
    at = 0
    for part in parts:  # a part is handed back before the next is cut
        assert len(part) == 1 or sum(len(t or "") for t in texts[at : at + len(part)]) <= 40
        at += len(part)
    assert list(encoder.encode_parts(pa.array([], pa.string()))) == [[]]


def test_token_histogram(spark):
    rng = random.Random(1)
    lengths = [rng.choice([0, 1, 5, 5, 4096, 5000, 9000, rng.randint(0, 20000)]) for _ in range(500)] + [None]
    df = spark.createDataFrame([(x,) for x in lengths], "n long")
    sums = token_counts.suffix_sums(token_counts.histogram(df, F.col("n")))
    plain = [x or 0 for x in lengths]
    for row in sums.collect():
        at = row.length
        assert row.n_docs == plain.count(at) and row.docs_from == sum(x >= at for x in plain)
        assert row.tokens_from == sum(x for x in plain if x >= at) and row.truncated == sum(min(x, at) for x in plain)
    limits = [0, 3, 5, 4096, 7000, 10**6]
    for row in token_counts.truncated_totals(sums, limits).collect():
        assert row.tokens == sum(min(x, row.limit) for x in plain) and row.truncated_docs == sum(x > row.limit for x in plain)
    for row in token_counts.quantiles(sums, [0.0, 0.5, 0.99, 1.0]).collect():
        assert row.length == min(x for x in plain if sum(y <= x for y in plain) >= row.share * len(plain))
    nothing = token_counts.suffix_sums(token_counts.histogram(df.limit(0), F.col("n")))
    assert nothing.count() == 0 and [r.tokens for r in token_counts.truncated_totals(nothing, [7]).collect()] == [0]


def _plain_statistics(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_statistics(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "c ", "é#", "\n", "a b c ", "\x0b", "|"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts + [None, "", "x" * 100_000, "a a a a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "_stats": F.lit(0)})
    none = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0), quality.DIRECTIONS)
    got = quality.assess(docs, none).select("doc_id", "_stats.*", "base_failed", "kept").collect()
    for row in got:
        text = rows[row.doc_id][1] or ""
        want = _plain_statistics(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (row.kept and row.base_failed)
    assert len(got) == len(rows)


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(4)
    rows = rng.random((2000, 3))
    labels = (rows[:, 0] + 0.2 * rng.normal(size=2000) < 0.5).astype(float)
    trees = quality.fit(rows, labels, np.array([-1, 0, 1]))
    assert ((trees.score(rows) > 0.5) == labels).mean() > 0.85
    grid = np.tile(rng.random((50, 1, 3)), (1, 20, 1))
    for feature, sign in ((0, -1), (2, 1)):
        line = grid.copy()
        line[:, :, feature] = np.linspace(0, 1, 20)
        assert (sign * np.diff(trees.score(line.reshape(-1, 3)).reshape(50, 20), axis=1) >= -1e-12).all()


def _plain_score(text, model):
    words = toxicity.split(text)
    if not words:
        return 1 / (1 + np.exp(-model.bias))
    sums = []
    for w in words:
        grams, _ = toxicity.subwords([w])
        sums.append((model.buckets[grams].astype(float).sum(), len(grams)))
    size = min(toxicity.WINDOW, len(words))
    means = [sum(s for s, _ in sums[i : i + size]) / max(1, sum(n for _, n in sums[i : i + size])) for i in range(len(words) - size + 1)]
    return 1 / (1 + np.exp(-(model.bias + max(means))))


def test_toxicity_scores_and_accuracy(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ba", "du", "ki", "lo", "me", "zu"]) for _ in range(rng.randint(1, 3)))
    bad = ["grobian", "schuft", "lump"]
    docs = []
    for i in range(600):
        words = [word() for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((" ".join(words), int(i % 3 == 0)))
    model = toxicity.fit([t for t, _ in docs[:400]], np.array([y for _, y in docs[:400]]), steps=80)
    texts = [t for t, _ in docs[400:]] + [None, "", "lumpp " * 3, docs[0][0] * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    scores = {r.doc_id: r.s for r in df.select("doc_id", toxicity.score(df, model, F.col("text")).alias("s")).collect()}
    assert all(abs(scores[i] - _plain_score(t, model)) < 1e-6 for i, t in enumerate(texts))
    right = [(scores[i] >= 0.3) == bool(y) for i, (_, y) in enumerate(docs[400:])]
    assert np.mean(right) > 0.95
    assert toxicity.fit([], np.zeros(0)).bias < 0


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(50)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", {0: 5, 1: 7}, F.col("doc_id") != 9, max_chars=60).collect()
    assert sum(r.toxic == 0 for r in got) == 5 and sum(r.toxic == 1 for r in got) == 7 and 9 not in {r.doc_id for r in got}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(6)
    parent = [-1, 0, 0, 1, 1, 2, 5]
    own, pair = rng.normal(size=7), rng.normal(size=(7, 2, 2))
    weights = {}
    for k in range(128):
        y = [(k >> i) & 1 for i in range(7)]
        weights[tuple(y)] = np.exp(sum(own[i] * y[i] for i in range(7)) + sum(pair[i, y[parent[i]], y[i]] for i in range(1, 7)))
    total = sum(weights.values())
    p, edges = html_text.marginals(own, pair, np.array(parent), html_text.levels_of(parent))
    for i in range(7):
        assert abs(p[i] - sum(w for y, w in weights.items() if y[i]) / total) < 1e-9
        if i:
            assert abs(edges[i, 1, 0] - sum(w for y, w in weights.items() if y[parent[i]] and not y[i]) / total) < 1e-9


def test_html_text(spark):
    model = html_text.trained(n_pages=300)
    wrong = total = 0
    for page in html_text.labelled_pages(150, 77):
        tree = html_text.parse(page)
        p = html_text.content(tree, model)
        seen = [(bool(m), q >= 0.5) for m, q, t, hidden in zip(tree.marked, p, tree.text, tree.hidden) if t and t.strip() and not hidden]
        wrong, total = wrong + sum(a != b for a, b in seen), total + len(seen)
    assert wrong < 0.02 * total
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></li></ul></nav><article><h1>One &amp; two</h1><p>First&nbsp;line  here, with\nwords.<p>Second one<br>broken <b>bold</b>.</article><footer>&copy; x.example.com</footer>"
    rows = [(1, page), (2, None), (3, ""), (4, "<div>" * 5000 + "deep"), (5, page), (6, "<<<>&#xD800;&bogus; </x")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(0))
    got = {r.page_id: r.t for r in df.select("page_id", html_text.main_text(df, F.col("html"), model).alias("t")).collect()}
    assert got[1] == got[5] == "One & two\nFirst line here, with words.\nSecond one\nbroken bold."
    assert got[2] == got[3] == "" and len(got) == 6
