"""PII, decontamination, the Jaccard join, substring dedup, WARC revisits and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonetide.llm import chunks, components, decontaminate, jaccard, pii, queries, warc

SF_DIR = "/root/testdata/sf0.001"


def _words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def _luhn_right(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PRIVATE = [
    ("card 4111 1111 1111 1111.", r"card \d{4} \d{4} \d{4} \d{4}\."),
    ("+1 (017) 555-7713", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    ("at 97.51.17.173,", r"at \d+\.\d+\.\d+\.\d+,"),
    ("ssn 123-45-6789", r"ssn \d{3}-\d{2}-\d{4}"),
    ("2024-02-29", r"\d{4}-\d{2}-\d{2}"),
    ("mail und.34@mail7.example.com!", r"mail [a-z]{3}\.\d\d@mail7\.example\.com!"),
    ("DE89 3704 0044 0532 0130 00", r"DE\d\d( \d{4}){4} \d\d"),
    ('"9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', r'"[0-9a-f]{40}"'),
]
PUBLIC = [None, "", "4111 1111 1111 1112", "1.2.3.999", "000-12-3456", "2023-02-30", "666-12-3456", "DE88370400440532013000", "version 2.0.1 of 12", "x" * 200_000]


def test_pseudonyms_keep_formats_and_invert(spark):
    texts = [t for t, _ in PRIVATE] + PUBLIC + [PRIVATE[0][0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"_found": F.lit(1), "n": F.lit("x")})
    out = pii.pseudonymised(df.drop("n"), "key one", replaced="n").select("doc_id", "text", "n")
    got = {r.doc_id: r for r in out.collect()}
    for i, (text, form) in enumerate(PRIVATE):
        assert got[i].text != text and re.fullmatch(form, got[i].text) and got[i].n == 1
    for i, text in enumerate(PUBLIC, len(PRIVATE)):
        assert got[i].text == text and got[i].n == 0
    assert _luhn_right(re.sub(r"\D", "", got[0].text)) and got[0].text == got[len(texts) - 1].text
    back = {r.doc_id: r.text for r in pii.pseudonymised(out, "key one", inverse=True).collect()}
    assert back == dict(enumerate(texts))
    other = {r.doc_id: r.text for r in pii.pseudonymised(df, "key two").collect()}
    assert all(other[i] != got[i].text for i in range(len(PRIVATE)))
    assert "Python" not in out._jdf.queryExecution().toString()
    assert pii.pseudonymised(df.limit(0), "k").count() == 0


def test_feistel_is_a_permutation_and_as_defined(spark):
    df = spark.range(17 * 29)
    pair = pii.feistel("k", "t", F.floor(F.col("id") / 29), F.col("id") % 29, F.lit(17), F.lit(29))
    got = {r.id: (r.p.left, r.p.right) for r in df.select("id", pair.alias("p")).collect()}
    assert len(set(got.values())) == 17 * 29

    def keyed(step, half, size):
        return int(hashlib.sha256(f"k|t|{step}|{half}|k".encode()).hexdigest()[:15], 16) % size

    for i in (0, 5, 100, 492):
        left, right = divmod(i, 29)
        for step in range(pii.ROUNDS):
            if step % 2 == 0:
                left = (left + keyed(step, right, 17)) % 17
            else:
                right = (right + keyed(step, left, 29)) % 29
        assert got[i] == (left, right)


def _contaminated_plainly(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for item, t in items:
        w = split(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(item)
    sizes = {len(w) for w in windows}
    for t in texts:
        w = split(t)
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                own = windows.get(tuple(w[k : k + m]))
                if own:
                    hit |= set(range(k, k + m))
                    found |= own
        yield len(w), len(hit), sorted(str(i) for i in found if i is not None), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_contamination(spark):
    rng = random.Random(7)
    items = [(i, " ".join(_words(rng, n, 30))) for i, n in enumerate([1, 2, 4, 5, 9, 13, 14, 40])] + [(8, "a " * 30), (9, None), (10, ""), (10, "Solo"), (3, "é-Ü ZZ"), (0, "w1, W2")]
    items += [items[7]]
    texts = [None, "", "...", "a " * 500, "solo", "É-ü zz", "é-ü zz"]
    for _ in range(60):
        w = _words(rng, rng.randint(0, 120), 30)
        part = rng.choice(items)[1] or ""
        at = rng.randint(0, len(w))
        texts.append(" ".join([*w[:at], *part.split()[rng.randint(0, 3) :], *w[at:]]).upper())
    texts += [texts[-1], texts[-2]]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"n_words": F.lit("x"), "row": F.monotonically_increasing_id()})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = decontaminate.contamination(docs, bench)
    assert "Python" not in got._jdf.queryExecution().toString()
    rows = sorted(((r.text or "", r.text is None, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()), key=repr)
    want = sorted(((t or "", t is None, n, hit, tuple(ids), bad) for t, (n, hit, ids, bad) in zip(texts, _contaminated_plainly(texts, items))), key=repr)
    assert rows == want
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_contamination_of_texts_that_begin_or_end_inside_a_window(spark, broadcast):
    passage = [f"b{i}" for i in range(24)]
    items = [(1, " ".join(passage)), (2, " ".join(passage[:7])), (3, "x y")]
    texts = [" ".join(passage[at : at + n] + ["z"] * tail) for at in range(14) for n, tail in [(5, 0), (13, 0), (13, 30), (24, 1)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = decontaminate.contamination(docs, bench).sort("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in got] == list(_contaminated_plainly(texts, items))


def _groups_plainly(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    small = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            small[root(i)] = min(small.get(root(i), d), d)
    return sorted(((d, len(sets[i]), small.get(root(i), d)) for i, (d, _) in enumerate(rows)), key=repr)


def test_jaccard_groups(spark):
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE\ttwo"), (5, "one two three"), (None, "one two"), (6, "a " * 3000), (7, "a " * 40)]
    boiler = " ".join(_words(rng, 60, 5000))
    for family in range(12):
        base = _words(rng, rng.choice([8, 30, 120, 400]), 5000)
        for _ in range(rng.choice([1, 2, 9, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy) + (" " + boiler) * (family % 3 == 0)))
    rows += [rows[20], (rows[21][0], rows[30][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "n": F.lit("x"), "root": F.lit(2)})
    got = sorted((tuple(r) for r in jaccard.groups(docs).collect()), key=repr)
    assert got == _groups_plainly(rows)
    assert jaccard.groups(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(None, 1), (5, None), (4, 4)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(10)
    shared = " ".join(_words(rng, 80, 10**6))
    rows = [(i, " ".join(_words(rng, rng.randint(0, 300), 10**6))) for i in range(60)]
    planted = set()
    for i in (3, 17, 40, 41):
        words = rows[i][1].split()
        at = rng.randint(0, len(words))
        rows[i] = (i, " ".join([*words[:at], shared, *words[at:]]))
        planted.add(i)
    rows += [(60, None), (61, ""), (62, shared[:40]), (None, shared), (63, "z " * 400 + "z " * 400), (64, rows[5][1] + " y"), rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("x"), "first_doc_id": F.lit(1)})
    found = chunks.repeated_passages(docs).collect()
    long = {5, 64} if len(rows[5][1].split()) >= 45 else set()
    assert {r.doc_id for r in found if r.doc_id not in (5, 64)} == planted and long <= {r.doc_id for r in found}
    texts = dict(r for r in rows if r[0] is not None)
    for r in found:
        piece = texts[r.doc_id].encode()[r.start : r.start + r.n_bytes]
        if r.doc_id in planted:
            assert r.first_doc_id == 3 and piece in shared.encode()
    kept = {r.doc_id: r.text for r in chunks.without_repeats(docs).collect() if r.doc_id is not None}
    assert kept[3] == texts[3] and all(len(kept[i]) < len(texts[i]) - 250 for i in planted - {3}) and kept[60] is None
    assert chunks.repeated_passages(docs.limit(0)).count() == 0


def test_cuts_follow_content():
    rng = random.Random(11)
    body = bytes(rng.randrange(97, 123) for _ in range(5000))
    ends, digests, _ = chunks.chunks(body)
    moved, again, _ = chunks.chunks(b"inserted " + body)
    assert len(set(digests.tolist()) & set(again.tolist())) > 0.95 * len(set(digests.tolist()))
    assert ends[-1] == len(body) and (ends[1:] > ends[:-1]).all()
    assert max(b - a for a, b in itertools.pairwise([0, *chunks.cuts(np.frombuffer(b"a" * 9000, dtype=np.uint8))])) <= chunks.LONGEST


def test_revisits(spark):
    head = {"content-type": "text/html", "date": "1", "etag": "e1"}
    rows = [
        ("a", "http://WWW.x.org/p/?b=2&a=1#top", 10, "response", 200, '"t"', None, "d", head, 1),
        ("b", "https://x.org:443/p?a=1&b=2", 25_000, "revisit", 304, 'W/"t"', None, None, {"date": "2", "set-cookie": "no"}, 2),
        ("c", "x.org/p?a=1&b=2", 25_001, "response", 500, '"u"', None, "d", head, 3),
        ("d", "x.org/p?a=1&b=2", 25_002, "revisit", 304, '"u"', None, "d", {}, 4),
        ("e", "x.org/q", 5, "revisit", 304, None, None, "d", None, 5),
        ("f", "x.org/q", 6, "response", 200, None, None, "d", None, 6),
        ("g", "x.org/q", 6, "revisit", 304, '"t"', "m", "d", {"vary": "v"}, 7),
        ("h", "x.org/q", 7, "revisit", 304, '"t"', "m", None, None, 8),
        ("i", None, 7, "revisit", 304, None, None, "d", None, 9),
        ("j", "x.org/q", None, "revisit", 304, None, None, "d", None, 10),
    ]
    kinds = "record_id string, url string, captured_at long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, canonical int"
    records = spark.createDataFrame(rows + [rows[1]], kinds).withColumn("_near", F.lit(1))
    got = warc.resolve(records).collect()
    by = {r.record_id: (r.response_id, r.outcome, r.headers) for r in got}
    assert len(got) == 8
    assert by["b"] == ("a", "resolved", {"content-type": "text/html", "date": "2", "etag": "e1"})
    assert by["d"][:2] == ("a", "mismatch") and by["e"][:2] == (None, "orphan") and by["g"] == ("f", "resolved", {"vary": "v"})
    assert by["h"][:2] == ("f", "unverified") and by["i"][:2] == by["j"][:2] == (None, "orphan")
    assert warc.resolve(records.limit(0)).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    quality, near, clean, private, _ = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    groups = _groups_plainly(rows)
    one = {d for d, _, g in groups if d == g}
    assert {r.doc_id for r in near(spark, kept, SF_DIR).collect()} == one
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if d in one]
    left = {d for (d, _), (*_, bad) in zip(rows, _contaminated_plainly([t for _, t in rows], items)) if not bad}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert set(got) == left
    texts = {r.doc_id: r.text for r in private(spark, docs, SF_DIR).collect()}
    import public_tokenizers

    from zonetide.llm import bpe

    encoder = bpe.Encoder(bpe.parse_ranks(open(queries.VOCABULARY, "rb").read()), public_tokenizers.PATTERN)
    assert all(encoder.decode(encoder.encode(texts[d])) == texts[d].encode() and r.n_tokens == len(encoder.encode(texts[d])) // 4 for d, r in got.items())
