"""Run log, freshness and overview over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.times import day_of
from ...operators import aggregates, runs
from ...operators.upsert import POLICIES, fold
from .. import reports
from .registry import query, table

NOW = "2024-01-31 12:00:00"

_EVENTS_SQL = """
  WITH e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS run_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
      CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'invalid' ELSE 'heartbeat' END AS event,
      CASE WHEN value > 50 THEN 'failed' WHEN value > 20 THEN 'partial' ELSE 'success' END AS status,
      CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS err,
      CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 3 <> 0 THEN 'n' || CAST(json_extract(props, '$.k') AS BIGINT) END AS notes, event_type FROM events),
  s AS (SELECT run_id, min(seq) AS first FROM e WHERE event = 'start' GROUP BY run_id),
  a AS (SELECT e.*, first FROM e JOIN s ON s.run_id = e.run_id WHERE seq >= first AND event <> 'invalid'),
  runs AS (SELECT run_id, min(ts) FILTER (seq = first) AS started_at, arg_max(ts, seq) FILTER (event = 'finish') AS finished_at,
      coalesce(arg_max(status, seq) FILTER (event = 'finish'), 'running') AS status,
      coalesce(arg_max(k, seq) FILTER (event <> 'start'), 0) AS domains_processed,
      coalesce(arg_max(err, seq) FILTER (event <> 'start'), 0) AS errors_count, min(event_type) FILTER (seq = first) AS source,
      coalesce(arg_max(notes, seq) FILTER (event = 'finish' AND notes IS NOT NULL), min(notes) FILTER (seq = first)) AS notes
    FROM a GROUP BY run_id)
"""
_LAST_SQL = "SELECT *, coalesce(finished_at, started_at) AS last_run_at FROM runs ORDER BY last_run_at DESC, run_id DESC LIMIT 1"


def run_events(events: DataFrame) -> DataFrame:
    """Events as run lifecycle events of their user."""
    kind = (
        F.when(F.col("event_type") == "signup", "start")
        .when(F.col("event_type") == "purchase", "finish")
        .when(F.col("event_type") == "error", "invalid")
        .otherwise("heartbeat")
    )
    k = F.get_json_object("props", "$.k")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("run_id"),
        F.substring(F.col("ts").cast("string"), 1, 19).alias("ts"),
        kind.alias("event"),
        F.when(F.col("value") > 50, "failed").when(F.col("value") > 20, "partial").otherwise("done").alias("status"),
        k.alias("domains_processed"),
        F.col("value").alias("errors_count"),
        F.col("event_type").alias("source"),
        F.when(k.cast("bigint") % 3 != 0, F.concat(F.lit("n"), k)).alias("notes"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.fold_runs(runs.clean_events(run_events(table(spark, sf_dir, "events"))))


@query(_EVENTS_SQL + "SELECT * FROM runs")
def run_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(spark, sf_dir)


@query(_EVENTS_SQL + _LAST_SQL)
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest_run(run_log(spark, sf_dir))


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS run_id, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(o_orderkey) AS BIGINT) AS domains_processed,
      CAST(count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 400000) AS BIGINT) AS upload_failures, bool_or(o_totalprice > 490000) AS timed_out,
      CASE WHEN bool_or(o_orderstatus = 'P' AND o_totalprice > 400000) OR bool_or(o_totalprice > 490000) THEN 'partial' ELSE 'success' END AS status
    FROM orders GROUP BY o_custkey"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as blocks of their customer's run."""
    failed = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)
    blocks = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("run_id"),
        F.col("o_orderkey").alias("domains"),
        (~failed).alias("uploaded"),
        (F.col("o_totalprice") > 490000).alias("timed_out"),
    )
    return aggregates.run_summary(blocks)


# ---- daily totals -------------------------------------------------------------------

_DAYS_SQL = """
  WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(sum(user_id) AS BIGINT) AS domains_tracked_lifetime,
      CAST(count(*) AS BIGINT) AS domains_tracked_24h, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY 1)
"""


def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "events").select(
        day_of("ts").alias("date"),
        F.col("user_id").alias("domains_tracked_lifetime"),
        F.lit(1).cast("bigint").alias("domains_tracked_24h"),
        F.substring(F.col("ts").cast("string"), 1, 19).alias("applied_at"),
        F.col("event_id").alias("seq"),
    )
    return fold(ledger, POLICIES["global_stats"])


@query(_DAYS_SQL + "SELECT * FROM g")
def global_stats_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_stats(spark, sf_dir)


@query(_DAYS_SQL + "SELECT CAST(sum(domains_tracked_lifetime) AS BIGINT) AS domains_tracked_lifetime FROM g")
def overview_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.lifetime_total(global_stats(spark, sf_dir))


@query(_DAYS_SQL + "SELECT * FROM g ORDER BY date DESC LIMIT 1")
def latest_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_global(global_stats(spark, sf_dir))


_CHECKS_SQL = f"""
  , last AS ({_LAST_SQL}),
  g AS (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events),
  ages AS (SELECT 'last_run' AS name, CAST(floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(CAST(last_run_at AS TIMESTAMP))) / 3600000.0 + 0.5) AS BIGINT) AS age_hours,
      status, run_id FROM last
    UNION ALL SELECT 'data_freshness', CAST(floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(CAST(latest AS TIMESTAMP))) / 3600000.0 + 0.5) AS BIGINT), NULL, NULL FROM g),
  checks AS (SELECT name, age_hours <= 30 AND coalesce(status, '') <> 'failed' AS ok, age_hours, status AS last_run_status,
      CASE WHEN age_hours > 30 THEN 'stale: ' || age_hours || 'h since last ' || CASE name WHEN 'last_run' THEN 'run' ELSE 'upload' END || ' (threshold 30h)'
           WHEN status = 'failed' THEN 'last run status=failed (run_id=' || run_id || ')'
           WHEN name = 'last_run' THEN 'ok: ' || age_hours || 'h since last ' || status || ' run'
           ELSE 'ok: ' || age_hours || 'h since last upload' END AS message FROM ages)
"""


@query(_EVENTS_SQL + _CHECKS_SQL + "SELECT * FROM checks")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.freshness(run_log(spark, sf_dir), global_stats(spark, sf_dir), NOW)


@query(
    _EVENTS_SQL
    + _CHECKS_SQL
    + "SELECT bool_and(ok) AS ok, CASE WHEN bool_and(ok) THEN 'ok' ELSE 'degraded' END AS status FROM checks"
)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health(reports.freshness(run_log(spark, sf_dir), global_stats(spark, sf_dir), NOW))


@query(
    _EVENTS_SQL
    + f""", last AS ({_LAST_SQL}),
    d AS (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 1)
    SELECT (SELECT CAST(sum(user_id) AS BIGINT) FROM events) AS domains_tracked_lifetime, CAST(d.n AS BIGINT) AS domains_tracked_24h,
      d.at AS last_updated_at, last_run_at, last.status AS last_run_status FROM d, last"""
)
def overview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = global_stats(spark, sf_dir)
    return reports.overview(totals, _length_table(spark, sf_dir), _word_table(spark, sf_dir), run_log(spark, sf_dir)).totals


def _length_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as stored length rows, one TLD of which is the roll-up."""
    ledger = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "overall").otherwise("2026-01-01").alias("snap_date"),
        F.when(F.col("l_returnflag") == "R", "ALL").otherwise(F.lower("l_returnflag")).alias("tld"),
        F.col("l_linenumber").cast("bigint").alias("length"),
        F.lit(36).cast("bigint").alias("total_possible"),
        F.lit(1).cast("bigint").alias("tracked_count"),
        (F.col("l_quantity") > 25).cast("bigint").alias("unregistered_found"),
        (F.col("l_quantity") > 40).cast("bigint").alias("unused_found"),
        F.lit(0).alias("seq"),
    )
    return fold(ledger, POLICIES["length_stats"])


def _word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _length_table(spark, sf_dir).withColumn("pos", F.lit("noun"))
    return words.drop("total_possible")


_LENGTHS_SQL = """CAST(l_linenumber AS BIGINT) AS length, {more} CAST(count(*) AS BIGINT) AS tracked,
  CAST(count(*) FILTER (l_quantity > 25) AS BIGINT) AS unregistered_found, CAST(count(*) FILTER (l_quantity > 40) AS BIGINT) AS unused_found
  FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag {tld} 'R' GROUP BY ALL"""
_POSSIBLE = "CAST(36 AS BIGINT) AS total_possible,"


@query("SELECT " + _LENGTHS_SQL.format(more=_POSSIBLE, tld="="))
def overview_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.length_counts(_length_table(spark, sf_dir))


@query("SELECT lower(l_returnflag) AS tld, " + _LENGTHS_SQL.format(more=_POSSIBLE, tld="<>"))
def overview_tld_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tld_length_counts(_length_table(spark, sf_dir))


@query("SELECT 'noun' AS pos, " + _LENGTHS_SQL.format(more="", tld="="))
def word_stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.word_counts_report(_word_table(spark, sf_dir))
