"""Merge policies, first-wins and batch deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...operators.corpus import first_wins
from ...operators.upsert import POLICIES, fold, prepare, upsert
from ...functions.times import day_of, month_of
from ...streaming.uploads import new_uploads, not_yet_applied
from .registry import query, table


@query(
    """SELECT 'overall' AS snap_date, lower(l_returnflag) AS tld, CAST(l_linenumber AS BIGINT) AS length,
      arg_max(l_partkey, (l_shipdate, l_orderkey, l_partkey)) AS total_possible, CAST(sum(l_quantity) AS BIGINT) AS tracked_count,
      CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS unregistered_found, CAST(count(*) AS BIGINT) AS unused_found
    FROM lineitem GROUP BY ALL"""
)
def upsert_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as uploaded length rows: counters add up, the last total stands."""
    ledger = table(spark, sf_dir, "lineitem").select(
        F.lit("overall").alias("snap_date"),
        F.lower("l_returnflag").alias("tld"),
        F.col("l_linenumber").cast("bigint").alias("length"),
        F.col("l_partkey").alias("total_possible"),
        F.col("l_quantity").cast("bigint").alias("tracked_count"),
        (F.col("l_linestatus") == "O").cast("bigint").alias("unregistered_found"),
        F.lit(1).cast("bigint").alias("unused_found"),
        "l_shipdate",
        "l_orderkey",
        "l_partkey",
    )
    return fold(ledger, POLICIES["length_stats"], ["l_shipdate", "l_orderkey", "l_partkey"])


@query(
    """SELECT strftime(o_orderdate, '%Y-%m') AS report_month, o_custkey AS iana_id, lower(o_orderstatus) AS tld,
      CAST(arg_max(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END, 0), o_orderkey) AS BIGINT) AS net_adds,
      max(o_orderkey) AS renewals, CAST(0 AS BIGINT) AS transfers,
      arg_max(o_orderpriority, o_orderkey) FILTER (o_orderpriority <> '5-LOW') AS source_url
    FROM orders GROUP BY ALL"""
)
def upsert_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registrar rows: the last counts stand, missing ones as 0."""
    rows = table(spark, sf_dir, "orders").select(
        month_of("o_orderdate").alias("report_month"),
        F.col("o_custkey").alias("iana_id"),
        F.lower("o_orderstatus").alias("tld"),
        F.when(F.col("o_orderkey") % 3 != 0, F.floor("o_totalprice")).alias("net_adds"),
        F.col("o_orderkey").alias("renewals"),
        F.lit(None).cast("bigint").alias("transfers"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("source_url"),
        F.col("o_orderkey").alias("seq"),
    )
    policy = POLICIES["registrar_monthly_stats"]
    return fold(prepare(rows, policy), policy)


_KEEP_SQL = """SELECT 'tld' || o_custkey AS tld, arg_max(o_orderstatus, {seq}) AS type,
      arg_max(o_orderpriority, {seq}) FILTER (o_orderpriority <> '5-LOW') AS registry,
      arg_max(strftime(o_orderdate, '%Y-%m-%d'), {seq}) FILTER (o_orderstatus = 'P') AS launched_at,
      arg_max(o_totalprice > 300000, {seq}) AS in_czds, arg_max(CASE WHEN o_orderkey % 4 = 0 THEN 'retired' ELSE 'active' END, {seq}) AS status
    FROM orders GROUP BY o_custkey"""


def _tld_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("tld"), F.col("o_custkey").cast("string")).alias("tld"),
        F.col("o_orderstatus").alias("type"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("registry"),
        F.when(F.col("o_orderstatus") == "P", day_of("o_orderdate")).alias("launched_at"),
        F.when(F.col("o_totalprice") > 300000, F.lit(True)).alias("in_czds"),
        F.when(F.col("o_orderkey") % 4 == 0, "retired").alias("status"),
        F.col("o_orderkey").alias("seq"),
        "o_orderdate",
    )


@query(_KEEP_SQL.format(seq="o_orderkey"))
def upsert_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as TLD rows: attributes survive a missing value, class, flag and status do not."""
    policy = POLICIES["tld_dim"]
    return fold(prepare(_tld_rows(spark, sf_dir), policy), policy).select("tld", "type", "registry", "launched_at", "in_czds", "status")


@query(_KEEP_SQL.format(seq="(o_orderdate >= TIMESTAMP '1998-07-01', o_orderkey)"))
def upsert_into_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two steps: a stored table of the earlier orders, then the later ones."""
    policy = POLICIES["tld_dim"]
    rows = _tld_rows(spark, sf_dir)
    early = F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz")
    current = fold(prepare(rows.filter(early), policy), policy)
    return upsert(current, rows.filter(~early), policy).select("tld", "type", "registry", "launched_at", "in_czds", "status")


@query(
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1"""
)
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return first_wins(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_IDS_SQL = """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS batch_id, ts FROM events),
  f AS (SELECT run_id, batch_id, min(event_id) AS event_id FROM e WHERE batch_id IS NOT NULL GROUP BY 1, 2
        UNION ALL SELECT run_id, batch_id, event_id FROM e WHERE batch_id IS NULL)"""


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uploads; error events carry no batch id and are never duplicates."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("run_id"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k")).alias("batch_id"),
        day_of("ts").alias("day"),
    )


@query(_IDS_SQL + " SELECT run_id, batch_id, event_id FROM f")
def dedupe_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = _uploads(spark, sf_dir).drop("day")
    return new_uploads(uploads, uploads.filter(F.lit(False)), ["event_id"])


@query(
    """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS batch_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events)
    SELECT event_id, run_id, CASE WHEN event_type <> 'error' THEN batch_id END AS batch_id FROM e
    WHERE day >= '2024-01-16' AND (event_type = 'error' OR (run_id, batch_id) NOT IN
      (SELECT (run_id, batch_id) FROM e WHERE day < '2024-01-16' AND event_type <> 'error'))"""
)
def already_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of the second half of the month whose ids the first half has not brought."""
    uploads = _uploads(spark, sf_dir)
    late = F.col("day") >= "2024-01-16"
    return not_yet_applied(uploads.filter(late).drop("day"), uploads.filter(~late))
