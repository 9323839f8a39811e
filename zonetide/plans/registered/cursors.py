"""Label enumeration and scan cursors. Nations stand for TLDs, their orders for labels probed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.fixed import LABEL_ALPHABET, TRACKED_TLDS
from ...functions.numbers import index_to_label, label_space
from ...operators import candidates
from .registry import query, table

BATCH = 5000


def _label_sql(index: str, width: int) -> str:
    digits = [f"substr('{LABEL_ALPHABET}', CAST(({index}) // {36**p} % 36 AS BIGINT) + 1, 1)" for p in range(width - 1, -1, -1)]
    return " || ".join(digits)


@query(
    f"""SELECT p_partkey, {_label_sql('p_partkey', 4)} AS label,
      {_label_sql('p_partkey * 1000003000003', 10)} AS wide_label,
      CAST(pow(36, 1 + p_partkey % 10) AS BIGINT) AS label_space FROM part"""
)
def label_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        index_to_label(key, 4).alias("label"),
        index_to_label(key * F.lit(1000003000003), 10).alias("wide_label"),
        label_space(1 + key % 10).alias("label_space"),
    )


_TLD_ARRAY_SQL = "[" + ", ".join(f"'{t}'" for t in TRACKED_TLDS) + "]"


@query(
    f"""WITH o AS (SELECT o_orderkey AS ordinal FROM orders),
    l AS (SELECT ordinal, CASE WHEN ordinal < 504 THEN 1 WHEN ordinal < 18648 THEN 2 WHEN ordinal < 671832 THEN 3 ELSE 4 END AS length,
            CASE WHEN ordinal < 504 THEN 0 WHEN ordinal < 18648 THEN 504 WHEN ordinal < 671832 THEN 18648 ELSE 671832 END AS start FROM o),
    x AS (SELECT ordinal, length, {_TLD_ARRAY_SQL}[(ordinal - start) // CAST(pow(36, length) AS BIGINT) + 1] AS tld,
            (ordinal - start) % CAST(pow(36, length) AS BIGINT) AS idx FROM l)
    SELECT ordinal, CAST(length AS INTEGER) AS length, tld, CAST(idx AS BIGINT) AS idx,
      right({_label_sql('idx', 4)}, length) AS label, right({_label_sql('idx', 4)}, length) || '.' || tld AS domain FROM x"""
)
def enumerate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordinals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"))
    return candidates.enumerate_at(ordinals, "ordinal")


_CURSORS_SQL = """
  WITH n AS (SELECT c_nationkey, 1 + c_nationkey % 3 AS length, count(*) AS c FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
  k AS (SELECT CAST(x.length AS INTEGER) AS length, n_name AS tld, n_nationkey AS tld_pos, CAST(coalesce(c, 0) AS BIGINT) AS next_index
        FROM nation CROSS JOIN (VALUES (1), (2), (3)) x(length) LEFT JOIN n ON c_nationkey = n_nationkey AND n.length = x.length)
"""
_BATCH_SQL = f"""
  , cand AS (SELECT length, tld, tld_pos, unnest(range(next_index, least(next_index + {BATCH}, CAST(pow(36, length) AS BIGINT)))) AS idx FROM k),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY length ORDER BY idx, tld_pos) AS rn FROM cand) WHERE rn <= {BATCH})
"""


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors at three lengths; each nation has been scanned at one of them."""
    nations = table(spark, sf_dir, "nation")
    per_customer = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    counted = (
        per_customer.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.sum("n").alias("next_index"))
    )
    stored = counted.join(nations, "n_nationkey").select(
        (1 + F.col("n_nationkey") % 3).alias("length"), F.col("n_name").alias("tld"), "next_index"
    )
    tlds = nations.select(F.col("n_name").alias("tld"), F.col("n_nationkey").alias("tld_pos"))
    return candidates.sync_cursors(stored, tlds, [1, 2, 3])


@query(_CURSORS_SQL + "SELECT length, tld, tld_pos, next_index FROM k")
def cursor_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synced(spark, sf_dir).select("length", "tld", "tld_pos", "next_index")


@query(
    _CURSORS_SQL
    + _BATCH_SQL
    + f"""SELECT length, tld, tld_pos, CAST(idx AS BIGINT) AS idx, right({_label_sql('idx', 3)}, length) AS label,
      right({_label_sql('idx', 3)}, length) || '.' || tld AS domain FROM b"""
)
def fair_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.fair_batch(synced(spark, sf_dir), BATCH)


@query(
    _CURSORS_SQL
    + _BATCH_SQL
    + """SELECT k.length, k.tld, k.tld_pos, CAST(greatest(k.next_index, coalesce(m.d, 0)) AS BIGINT) AS next_index
    FROM k LEFT JOIN (SELECT length, tld, max(idx) + 1 AS d FROM b GROUP BY length, tld) m ON k.length = m.length AND k.tld = m.tld"""
)
def cursor_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = synced(spark, sf_dir)
    moved = candidates.advance_cursors(cursors, candidates.fair_batch(cursors, BATCH))
    return moved.select("length", "tld", "tld_pos", "next_index")


@query(_CURSORS_SQL + "SELECT length, bool_and(next_index >= pow(36, length)) AS done FROM k GROUP BY length")
def exhausted_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.exhausted_lengths(synced(spark, sf_dir))


@query(
    _CURSORS_SQL
    + """, m AS (SELECT length, CAST(sum(next_index) AS DOUBLE) / count(*) AS mean_index FROM k GROUP BY length)
    SELECT k.length, tld, next_index, mean_index, mean_index - next_index AS lag FROM k JOIN m ON k.length = m.length
    WHERE next_index < mean_index"""
)
def cursor_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.cursor_lag(synced(spark, sf_dir))
