from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from zonetide.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("zonetide-tests")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    """All rows as a sorted list of plain tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, expression, value=None, kind="string"):
    """Value of a column function applied to a single input."""
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expression("v").alias("r")).head().r
