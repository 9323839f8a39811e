from __future__ import annotations

import json
import random

import pytest
from conftest import rows

from zonetide.sources import companies, large_documents

NASTY = ["a,b", "}{", '"', "\\", "\\\\", '\\"', '","', "]},", "ü€😀", "\n", "", " x ", "{\"a\":1}", "\\,", "/", ":"]


@pytest.fixture
def small_ranges(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "300")
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    return session


def _text(rng):
    return "".join(rng.choice(NASTY) for _ in range(rng.randrange(5)))


def _value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.randrange(10**6)
    if kind < 4:
        return _text(rng)
    if kind == 4:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"{_text(rng)}{i}": _value(rng, depth + 1) for i in range(rng.randrange(4))}


def _flat(value):
    """A member's value as the map reader gives it: strings bare, others as JSON."""
    return value if isinstance(value, str) or value is None else json.loads(json.dumps(value))


def test_members_of_split_documents(small_ranges, tmp_path):
    rng = random.Random(5)
    docs = [{f"{_text(rng)}-{i}": _value(rng) for i in range(n)} for n in (0, 1, 150, 400)]
    for i, doc in enumerate(docs):
        text = json.dumps(doc, ensure_ascii=i % 2 == 0, indent=[None, 1][i // 3])
        (tmp_path / f"{i}.json").write_text(f"\n {text} \n" if i % 2 else text, encoding="utf-8")
    found = large_documents.json_members(small_ranges, str(tmp_path)).collect()
    for i, doc in enumerate(docs):
        mine = sorted((r for r in found if r.file.endswith(f"/{i}.json")), key=lambda r: r.pos)
        assert [r.key for r in mine] == list(doc)
        assert [r.pos for r in mine] == list(range(len(doc)))
        for r, value in zip(mine, doc.values(), strict=True):
            assert (r.value if isinstance(value, str) or value is None else json.loads(r.value)) == _flat(value)


def test_tickers_and_overrides_equal_the_whole_reader(small_ranges, tmp_path):
    rng = random.Random(6)
    entries = {str(i): rng.choice([{"cik_str": i, "ticker": f"T{i}", "title": f"N{_text(rng)}{i}"}, {"ticker": "X"}, 7, "s", None]) for i in range(500)}
    flat = {f"{'Kk'[i % 2]}{i // 2}": f"{'Dd'[i % 2]}{_text(rng)}{i}" for i in range(400)}
    for name, doc in (("t", entries), ("o", flat)):
        (tmp_path / name).write_text(json.dumps(doc))
    whole = lambda name: companies.read_document(small_ranges, str(tmp_path / name))
    want = rows(companies.ticker_rows(whole("t")))
    assert len(want) > 50
    assert rows(large_documents.ticker_rows(small_ranges, str(tmp_path / "t"))) == want
    assert rows(large_documents.domain_overrides(small_ranges, str(tmp_path / "o"))) == rows(companies.domain_overrides(whole("o")))


def test_index_tickers_equal_the_whole_reader(small_ranges, tmp_path):
    rng = random.Random(7)

    def links():
        return "".join(f"<tr><td><a href='/x'>{rng.choice(['', 'a', 'TOOLONGX'])}{chr(65 + rng.randrange(26))}{rng.randrange(999)}</a>, text</td></tr>\n" for _ in range(rng.randrange(30)))

    for page in range(6):
        parts = []
        for _ in range(rng.randrange(2, 8)):
            tag = rng.choice(['<table class="wikitable sortable">', "<table>", "<p>", '<table id="x" class="wikitable"\n>'])
            parts.append(tag + links() + rng.choice(["</table>", "</table>", "</p>"]) + links())
        (tmp_path / f"{page}.html").write_text("".join(parts) + rng.choice(["", '<table class="wikitable">' + links()]))
    want = rows(companies.index_tickers(companies.read_document(small_ranges, str(tmp_path))))
    assert len(want) > 30
    assert rows(large_documents.index_tickers(small_ranges, str(tmp_path))) == want


def test_a_document_is_read_by_many_tasks(small_ranges, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({str(i): "v" * 20 for i in range(200)}))
    assert large_documents._pieces(small_ranges, str(tmp_path), ",").rdd.getNumPartitions() > 10
    assert large_documents.json_members(small_ranges, str(tmp_path)).count() == 200
