"""Hosts of pages as probed names: normalisation, verdicts, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.text import domain_label, domain_tld, normalize_domain
from ...operators import aggregates, probes
from .. import reports
from .registry import query, table

# Phrases that occur in the provided pages, in place of the usual ones.
PARKING = ["the thth", "onthe"]
PRODUCT = ["reti", "&amp;"]

HOSTS_SQL = r"""
  SELECT page_id, html,
         split_part(split_part(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''),
                    '^www\.', ''), '/', 1), '?', 1) AS domain
  FROM pages
"""
NAMES_SQL = rf"""
  WITH h AS ({HOSTS_SQL}),
  r AS (
    SELECT page_id, domain, split_part(domain, '.', 1) AS label,
           CAST(length(split_part(domain, '.', 1)) AS INTEGER) AS length,
           lower(split_part(domain, '.', -1)) AS tld, page_id % 7 <> 0 AS registered,
           CASE WHEN page_id % 3 = 0 THEN 'words' ELSE 'short' END AS mode,
           [200, 200, 301, 404, 503][page_id % 5 + 1] AS status,
           page_id % 11 <> 0 AS is_html, lower(html) AS t
    FROM h),
  n AS (
    SELECT page_id, domain, label, length, tld, registered, mode,
      CASE WHEN NOT registered OR status >= 400 THEN 'no_website'
           WHEN contains(t, 'the thth') OR contains(t, 'onthe') THEN 'parked_or_placeholder'
           WHEN status = 301 THEN 'parked_or_placeholder'
           WHEN is_html AND regexp_matches(t, '\S') THEN 'active_site'
           ELSE 'no_website' END AS usage_state,
      CASE WHEN registered AND status < 400 AND (contains(t, 'reti') OR contains(t, '&amp;'))
           THEN 'active_product' ELSE 'unknown' END AS product_state
    FROM r),
  c AS (
    SELECT *, registered AND usage_state IN ('no_website', 'parked_or_placeholder') AS unused,
           registered AND usage_state = 'active_site' AS active
    FROM n)
"""
_COUNTS_SQL = """CAST(count(*) AS BIGINT) AS tracked_count,
  CAST(count(*) FILTER (NOT registered) AS BIGINT) AS unregistered_found,
  CAST(count(*) FILTER (unused) AS BIGINT) AS unused_found"""


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captured home pages of probed names, one capture per page."""
    pages = table(spark, sf_dir, "pages")
    key = F.col("page_id")
    resolved = pages.select(
        "page_id",
        normalize_domain("url").alias("domain"),
        (F.pmod(key, F.lit(7)) != 0).alias("registered"),
        F.when(F.pmod(key, F.lit(3)) == 0, "words").otherwise("short").alias("mode"),
    )
    statuses = F.array(*[F.lit(s) for s in (200, 200, 301, 404, 503)])
    captured = pages.select(
        "page_id",
        F.get(statuses, F.pmod(key, F.lit(5)).cast("int")).alias("status"),
        F.when(F.pmod(key, F.lit(11)) != 0, "text/html; charset=utf-8").otherwise("application/json").alias("content_type"),
        F.col("html").alias("body"),
        F.lit(None).cast("string").alias("error"),
    )
    usage = probes.http_usage(captured, body_limit=None, parking=PARKING, product=PRODUCT)
    return probes.probe_results(resolved, usage, ["page_id"])


@query(
    f"""WITH h AS ({HOSTS_SQL})
    SELECT page_id, domain, split_part(domain, '.', 1) AS label,
      CAST(length(split_part(domain, '.', 1)) AS INTEGER) AS length, lower(split_part(domain, '.', -1)) AS tld
    FROM h"""
)
def normalize_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select("page_id", normalize_domain("url").alias("domain"))
    return hosts.select(
        "page_id",
        "domain",
        domain_label("domain").alias("label"),
        F.length(domain_label("domain")).alias("length"),
        domain_tld("domain").alias("tld"),
    )


@query(NAMES_SQL + "SELECT page_id, domain, registered, usage_state, product_state FROM n")
def usage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_names(spark, sf_dir).select("page_id", "domain", "registered", "usage_state", "product_state")


@query(
    NAMES_SQL
    + "SELECT CAST(count(*) AS BIGINT) AS domains_tracked_lifetime, CAST(count(*) AS BIGINT) AS domains_tracked_24h FROM c"
)
def global_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.global_totals(aggregates.probe_cells(page_names(spark, sf_dir)))


@query(
    NAMES_SQL
    + f"""SELECT length, CAST(pow(36, length) AS BIGINT) AS total_possible, {_COUNTS_SQL}
    FROM c WHERE mode = 'short' GROUP BY length"""
)
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.length_stats(aggregates.probe_cells(page_names(spark, sf_dir)))


@query(
    NAMES_SQL
    + f"""SELECT tld, length, CAST(pow(36, length) AS BIGINT) AS total_possible, {_COUNTS_SQL}
    FROM c WHERE mode = 'short' GROUP BY tld, length ORDER BY tld, length"""
)
def length_stats_by_tld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.length_stats_by_tld(aggregates.probe_cells(page_names(spark, sf_dir))).orderBy("tld", "length")


@query(
    NAMES_SQL
    + """SELECT tld, CAST(count(*) AS BIGINT) AS domains_checked_total,
      CAST(count(*) FILTER (length <= 10) AS BIGINT) AS short_domains_checked_total,
      CAST(count(*) FILTER (length <= 10 AND NOT registered) AS BIGINT) AS short_unregistered_count,
      CAST(count(*) FILTER (length <= 10 AND unused) AS BIGINT) AS short_no_website_count,
      CAST(count(*) FILTER (length <= 10 AND active) AS BIGINT) AS short_active_site_count
    FROM c GROUP BY tld"""
)
def tld_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.tld_stats(aggregates.probe_cells(page_names(spark, sf_dir)))


_G = _COUNTS_SQL


@query(
    NAMES_SQL
    + f"""SELECT 'global' AS level, NULL AS tld, CAST(NULL AS INTEGER) AS length, {_G} FROM c
    UNION ALL SELECT 'tld', tld, NULL, {_G} FROM c GROUP BY tld
    UNION ALL SELECT 'length', NULL, length, {_G} FROM c WHERE mode = 'short' GROUP BY length
    UNION ALL SELECT 'tld_length', tld, length, {_G} FROM c WHERE mode = 'short' GROUP BY tld, length"""
)
def all_aggregates_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.all_aggregates(aggregates.probe_cells(page_names(spark, sf_dir)))


@query(
    NAMES_SQL
    + """, l AS (SELECT length, count(*) AS t FROM c WHERE mode = 'short' GROUP BY length)
    SELECT CAST(sum(t) AS BIGINT) AS total_tracked,
           string_agg('L' || length || '=' || t, ', ' ORDER BY length) AS lengths FROM l"""
)
def batch_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.batch_summary(aggregates.length_stats(aggregates.probe_cells(page_names(spark, sf_dir))))


@query(
    NAMES_SQL
    + """, l AS (SELECT length, CAST(pow(36, length) AS BIGINT) AS total_possible, count(*) AS tracked_count,
        count(*) FILTER (NOT registered) AS unregistered_found, count(*) FILTER (unused) AS unused_found FROM c WHERE mode = 'short' GROUP BY length),
    t AS (SELECT tld, length, CAST(pow(36, length) AS BIGINT) AS total_possible, count(*) AS tracked_count,
        count(*) FILTER (NOT registered) AS unregistered_found, count(*) FILTER (unused) AS unused_found FROM c WHERE mode = 'short' GROUP BY tld, length)
    SELECT CAST(to_json({'date': '2026-01-01', 'global': {'domains_tracked_lifetime': (SELECT count(*) FROM c), 'domains_tracked_24h': (SELECT count(*) FROM c)},
      'length_stats': (SELECT list(l ORDER BY length) FROM l), 'length_stats_by_tld': (SELECT list(t ORDER BY tld, length) FROM t),
      'word_pos_stats': [], 'run_id': 'run-1', 'batch_id': 'batch-1'}) AS VARCHAR) AS value"""
)
def upload_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload document of one block made of all pages; no page is a dictionary word."""
    names = page_names(spark, sf_dir)
    cells = aggregates.probe_cells(names)
    no_words = names.select(F.col("label").alias("word"), F.lit("noun").alias("pos")).filter(F.lit(False))
    return reports.upload_document(
        "2026-01-01",
        aggregates.global_totals(cells),
        aggregates.length_stats(cells),
        aggregates.length_stats_by_tld(cells),
        aggregates.word_pos_stats(names, no_words),
        "run-1",
        "batch-1",
    )


# ---- captured DNS answers: one name per user, one answer per event ------------

_DNS_SQL = """
  WITH e AS (SELECT event_id, user_id, event_type AS resolver, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
  v AS (
    SELECT event_id, user_id, resolver,
      k % 10 = 0 OR k % 7 IN (0, 1) AS resolver_error,
      CASE WHEN k % 10 = 0 OR k % 7 IN (0, 1) THEN NULL ELSE k % 7 IN (2, 3) END AS registered
    FROM e)
"""


def event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS-JSON bodies built from events: no JSON, no status, answers, an empty list, a refusal."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.pmod(k, F.lit(7))
    body = (
        F.when(kind == 0, "not json")
        .when(kind == 1, F.concat(F.lit('{"TC":false,"id":'), k, F.lit("}")))
        .when(kind.isin(2, 3), F.concat(F.lit('{"Status":0,"Answer":[{"data":"10.0.0.'), k, F.lit('"}]}')))
        .when(kind == 4, '{"Status":0,"Answer":[]}')
        .when(kind == 5, '{"Status":0}')
        .otherwise('{"Status":3,"Answer":[{"data":"x"}]}')
    )
    return events.select(
        F.col("user_id"),
        F.col("event_type").alias("resolver"),
        F.col("event_id").alias("attempt"),
        F.when(F.pmod(k, F.lit(10)) == 0, 500).otherwise(200).alias("http_status"),
        body.alias("body"),
    )


@query(_DNS_SQL + "SELECT event_id AS attempt, resolver, resolver_error, registered FROM v")
def dns_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.dns_verdicts(event_answers(spark, sf_dir)).select("attempt", "resolver", "resolver_error", "registered")


@query(
    _DNS_SQL
    + """SELECT user_id, coalesce(arg_min(registered, event_id) FILTER (NOT resolver_error), false) AS registered,
      count(*) FILTER (NOT resolver_error) = 0 AS resolver_error FROM v GROUP BY user_id"""
)
def resolver_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.resolve(probes.dns_verdicts(event_answers(spark, sf_dir)), ["user_id"])


@query(
    _DNS_SQL
    + """SELECT resolver, CAST(count(*) FILTER (NOT resolver_error) AS BIGINT) AS ok,
      CAST(count(*) FILTER (resolver_error) AS BIGINT) AS err FROM v GROUP BY resolver"""
)
def resolver_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.resolver_counts(probes.dns_verdicts(event_answers(spark, sf_dir)))
