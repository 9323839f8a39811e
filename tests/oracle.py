"""Compare registered queries with their SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    '"NULL"': "string",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row, order):
    out = []
    for i in order:
        v = row[i]
        out.append(f"{v:.12g}" if isinstance(v, float) and math.isfinite(v) else str(v))
    return tuple(out)


def check(spark, con, sf_dir: str, name: str) -> list[str]:
    """Differences between a query and its SQL; an empty list means they agree."""
    df = entry_points.queries()[name](spark, sf_dir)
    sql = entry_points.oracle_sql().get(name)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return [] if got else ["no rows"]
    result = con.sql(sql)
    problems = []
    ours = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    theirs = {c: TYPES.get(str(t), str(t)) for c, t in zip(result.columns, result.types)}
    if ours != theirs:
        problems.append(f"schema {sorted(set(ours.items()) ^ set(theirs.items()))}")
    if sorted(ours) == sorted(theirs):
        names = sorted(ours)
        a = Counter(_key(r, [df.columns.index(n) for n in names]) for r in got)
        b = Counter(_key(r, [result.columns.index(n) for n in names]) for r in result.fetchall())
        if a != b:
            problems.append(f"{sum(a.values())} vs {sum(b.values())} rows; only ours {list((a - b))[:3]}; only theirs {list((b - a))[:3]}")
        elif not a:
            problems.append("no rows on either side")
    return problems


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry_points.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("PARTITIONS", "8")).config("spark.sql.session.timeZone", os.environ.get("ZONE", "UTC")).config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problems = check(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
