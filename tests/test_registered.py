from __future__ import annotations

import os

import pytest
from oracle import check, connect

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="provided tables not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query_agrees_with_its_sql(spark, con, name):
    assert check(spark, con, SF_DIR, name) == []


def test_entry(spark):
    found = entry_points.entry(spark)
    assert found.columns == ["tld", "length", "total_possible", "tracked_count", "unregistered_found", "unused_found"]
    assert found.count() > 0
