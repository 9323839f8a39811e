"""Provider shares: months of orders, customers as names, order attributes as providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.times import day_of, month_of
from ...operators import attribution, shares, zones
from ...operators.upsert import POLICIES, fold
from ...session import scratch_path
from .. import reports, zone_store
from .documents import rdap_answers
from .registry import query, table

_MEMBERS_SQL = """
  WITH p AS (
    SELECT strftime(o_orderdate, '%Y-%m') AS snap_month, o_custkey,
      arg_max_null(o_orderpriority, o_orderkey) AS ns_provider,
      arg_max_null(nullif(o_orderstatus, 'P'), o_orderkey) AS mx_provider,
      arg_max_null(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice > 250000 END, o_orderkey) AS dnssec,
      arg_max_null(o_orderpriority LIKE '%U%', o_orderkey) AS has_aaaa
    FROM orders GROUP BY 1, 2),
  tiered AS (
    SELECT p.*, list_filter([
        CASE WHEN c_acctbal > 5000 THEN 'sp500' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'russell1000' END,
        CASE WHEN c_nationkey % 2 = 0 THEN 'russell3000' END, 'all_us_public',
        CASE WHEN o_custkey + 1 <= 100 THEN 'tranco100' END, CASE WHEN o_custkey + 1 <= 1000 THEN 'tranco1000' END,
        CASE WHEN o_custkey + 1 <= 10000 THEN 'tranco10000' END, 'all'], lambda x: x IS NOT NULL) AS tiers
    FROM p JOIN customer ON c_custkey = o_custkey),
  m AS (SELECT * EXCLUDE (tiers), unnest(tiers) AS tier FROM tiered),
"""
_SHARE_SQL = (
    _MEMBERS_SQL
    + """
  tot AS (SELECT snap_month, tier, CAST(count(*) AS BIGINT) AS total FROM m GROUP BY 1, 2),
  u AS (SELECT snap_month, tier, 'ns' AS category, ns_provider AS provider_key FROM m
        UNION ALL SELECT snap_month, tier, 'mx', mx_provider FROM m),
  sh AS (SELECT u.snap_month, u.tier, category, provider_key, CAST(count(*) AS BIGINT) AS count, any_value(total) AS total,
           count(*) / CAST(any_value(total) AS DOUBLE) AS share
         FROM u JOIN tot ON u.snap_month = tot.snap_month AND u.tier = tot.tier
         WHERE provider_key IS NOT NULL GROUP BY 1, 2, 3, 4),
  lagged AS (SELECT *, lag(snap_month) OVER h AS pm, lag(count) OVER h AS pc, lag(share) OVER h AS ps FROM sh
         WINDOW h AS (PARTITION BY tier, category, provider_key ORDER BY snap_month)),
  d AS (SELECT snap_month, tier, category, provider_key, count, total, share,
      CASE WHEN pm = strftime(CAST(snap_month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') THEN count - pc END AS delta_count,
      CASE WHEN pm = strftime(CAST(snap_month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') THEN share - ps END AS delta_share
    FROM lagged)
"""
)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly probe rows: the last order of a customer in a month counts."""
    open_order = F.col("o_orderstatus") == "P"
    ledger = table(spark, sf_dir, "orders").select(
        month_of("o_orderdate").alias("snap_month"),
        F.col("o_custkey").cast("string").alias("domain"),
        F.col("o_orderpriority").alias("ns_provider"),
        F.when(~open_order, F.col("o_orderstatus")).alias("mx_provider"),
        F.when(~open_order, F.col("o_totalprice") > 250000).alias("dnssec"),
        F.col("o_orderpriority").contains("U").alias("has_aaaa"),
        F.col("o_orderkey").alias("seq"),
    )
    return fold(ledger, POLICIES["monthly_probe"])


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probes(spark, sf_dir)
    companies = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("canonical_domain"),
        (F.col("c_acctbal") > 5000).alias("in_sp500"),
        (F.col("c_mktsegment") == "BUILDING").alias("in_russell1000"),
        (F.col("c_nationkey") % 2 == 0).alias("in_russell3000"),
        F.lit(True).alias("in_us_public"),
    )
    months = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("domain"), month_of("o_orderdate").alias("snap_month")
    )
    ranks = months.distinct().withColumn("rank", F.col("domain").cast("bigint") + 1)
    return shares.with_tiers(found, companies, ranks)


def monthly_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.month_over_month(shares.provider_share(tiered(spark, sf_dir)))


@query(_MEMBERS_SQL.rstrip().rstrip(",") + " SELECT snap_month, CAST(o_custkey AS VARCHAR) AS domain, tier FROM m")
def tier_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered(spark, sf_dir).select("snap_month", "domain", F.explode("tiers").alias("tier"))


@query(_SHARE_SQL + "SELECT snap_month, tier, category, provider_key, count, total, share FROM sh")
def provider_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.provider_share(tiered(spark, sf_dir))


@query(_SHARE_SQL + "SELECT * FROM d")
def provider_share_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_shares(spark, sf_dir)


@query(
    _SHARE_SQL
    + """SELECT snap_month, tier, category, provider_key, count, total, share, delta_share FROM d
    WHERE snap_month = (SELECT max(snap_month) FROM d) AND category = 'ns' ORDER BY tier, category, share DESC, provider_key"""
)
def provider_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.provider_latest(monthly_shares(spark, sf_dir), category="ns")


@query(
    _SHARE_SQL
    + """SELECT snap_month, provider_key, count, total, share FROM d
    WHERE tier = 'sp500' AND category = 'ns' AND snap_month >= '1999-03' ORDER BY snap_month, share DESC, provider_key"""
)
def provider_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.provider_history(monthly_shares(spark, sf_dir), "sp500", "ns", months=24, now="2001-03-31 10:00:00")


@query(
    _MEMBERS_SQL.rstrip().rstrip(",")
    + """ SELECT snap_month, tier, count(*) FILTER (dnssec) / CAST(nullif(count(dnssec), 0) AS DOUBLE) AS dnssec_rate,
      count(*) FILTER (has_aaaa) / CAST(nullif(count(has_aaaa), 0) AS DOUBLE) AS ipv6_rate FROM m GROUP BY 1, 2"""
)
def adoption_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.adoption_rates(tiered(spark, sf_dir), {"dnssec": "dnssec", "ipv6": "has_aaaa"})


@query(
    """WITH n AS (SELECT l_suppkey, n_name, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT l_suppkey, n_name AS ns_country FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, n_name) AS rn FROM n) WHERE rn = 1"""
)
def modal_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("ns_country"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    seen = items.join(orders, "o_orderkey").join(customers, "c_custkey").join(nations, "c_nationkey")
    return shares.modal_value(seen, ["l_suppkey"], "ns_country")


@query(
    """WITH l AS (SELECT strftime(l_shipdate, '%Y-%m') AS snap_month, lower(l_returnflag) AS a, lower(l_linestatus) AS b, l_linenumber AS n FROM lineitem),
    t AS (SELECT snap_month, CAST(count(*) AS BIGINT) AS total FROM l GROUP BY 1),
    u AS (SELECT snap_month, 'analytics' AS category, a AS k FROM l UNION ALL SELECT snap_month, 'analytics', b FROM l WHERE a <> b
      UNION ALL SELECT snap_month, 'tag_manager', 'tag' || n FROM l WHERE n <> 3)
    SELECT u.snap_month, 'all' AS tier, category, k AS provider_key, CAST(count(*) AS BIGINT) AS count,
      any_value(total) AS total, count(*) / CAST(any_value(total) AS DOUBLE) AS share
    FROM u JOIN t ON u.snap_month = t.snap_month GROUP BY u.snap_month, category, k"""
)
def csv_provider_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as probe rows with comma-separated, repeating provider lists."""
    probe = table(spark, sf_dir, "lineitem").select(
        month_of("l_shipdate").alias("snap_month"),
        F.concat_ws(",", "l_returnflag", F.concat(F.lit(" "), "l_linestatus"), "l_returnflag", F.lit("")).alias("analytics_provider"),
        F.when(F.col("l_linenumber") != 3, F.concat(F.lit("tag"), F.col("l_linenumber").cast("string"))).alias("tag_managers"),
        F.array(F.lit("all")).alias("tiers"),
    )
    return shares.provider_share(probe)


# ---- zones: users active on a day, by event type ------------------------------------

_ZONE_SQL = """
  WITH z AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS snap_date, event_type AS tld, user_id AS domain FROM events),
  days AS (SELECT tld, snap_date, lag(snap_date) OVER w AS prior, CAST(count(*) AS BIGINT) AS registered_total
           FROM z GROUP BY tld, snap_date WINDOW w AS (PARTITION BY tld ORDER BY snap_date)),
  came AS (SELECT d.tld, d.snap_date, CAST(count(*) AS BIGINT) AS n FROM days d JOIN z ON z.tld = d.tld AND z.snap_date = d.snap_date
           WHERE d.prior IS NOT NULL AND NOT EXISTS (SELECT 1 FROM z y WHERE y.tld = d.tld AND y.snap_date = d.prior AND y.domain = z.domain) GROUP BY 1, 2),
  gone AS (SELECT d.tld, d.snap_date, CAST(count(*) AS BIGINT) AS n FROM days d JOIN z ON z.tld = d.tld AND z.snap_date = d.prior
           WHERE NOT EXISTS (SELECT 1 FROM z y WHERE y.tld = d.tld AND y.snap_date = d.snap_date AND y.domain = z.domain) GROUP BY 1, 2)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        day_of("ts").alias("snap_date"), F.col("event_type").alias("tld"), F.col("user_id").cast("string").alias("domain")
    )


_ZONE_DAYS_SQL = (
    _ZONE_SQL
    + """SELECT days.snap_date, days.tld, registered_total, coalesce(came.n, 0) AS new_today, coalesce(gone.n, 0) AS dropped_today
    FROM days LEFT JOIN came ON came.tld = days.tld AND came.snap_date = days.snap_date
    LEFT JOIN gone ON gone.tld = days.tld AND gone.snap_date = days.snap_date"""
)


@query(_ZONE_DAYS_SQL)
def zone_diff_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.zone_history(snapshots(spark, sf_dir))


@query(_ZONE_DAYS_SQL)
def zone_diff_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored days: digests are compared, names only where they differ."""
    home = scratch_path(spark, "zones")
    zone_store.store_snapshots(snapshots(spark, sf_dir), home, buckets=4, leaves=64)
    return zone_store.zone_history(spark, home)


# Sampled names per TLD and month; more come anew in a month, so the estimates have an error.
_KEPT = 12


@query(
    _ZONE_SQL
    + f""", fresh AS (SELECT DISTINCT d.tld, substr(d.snap_date, 1, 7) AS month, 'customer-' || z.domain || '.com' AS domain FROM days d JOIN z ON z.tld = d.tld AND z.snap_date = d.snap_date
        WHERE d.prior IS NOT NULL AND NOT EXISTS (SELECT 1 FROM z y WHERE y.tld = d.tld AND y.snap_date = d.prior AND y.domain = z.domain)),
    placed AS (SELECT *, CAST('0x' || substr(md5(domain), 1, 12) AS BIGINT) AS p FROM fresh),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY tld, month ORDER BY p, domain) AS r FROM placed),
    kept AS (SELECT k.*, coalesce((t.p + 0.5::DOUBLE) / 281474976710656::DOUBLE, 1) AS chance FROM ranked k
      LEFT JOIN ranked t ON t.tld = k.tld AND t.month = k.month AND t.r = {_KEPT + 1} WHERE k.r <= {_KEPT}),
    verdicts AS (SELECT 'customer-' || o_custkey || '.com' AS domain,
        arg_min(CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 1 THEN o_orderkey END IS NOT NULL, o_orderkey) AS named
      FROM orders WHERE o_orderkey % 5 IN (0, 1, 2) GROUP BY 1),
    each AS (SELECT tld, month, coalesce(named, false) AS attributed, count(*) AS n, min(chance) AS chance FROM kept LEFT JOIN verdicts v ON v.domain = kept.domain GROUP BY ALL)
    SELECT tld, month, attributed, CAST(n AS BIGINT) AS sampled, round(n / chance, 6) AS estimate, round(sqrt(n * (1 - chance)) / chance, 6) AS error FROM each"""
)
def attribution_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that came to a zone in a month, by whether RDAP names their registrar: estimated from a sample that is drawn in two parts."""
    home = scratch_path(spark, "attribution")
    zone_store.store_snapshots(snapshots(spark, sf_dir), home, buckets=4, leaves=64)
    came = zone_store.changed_names(spark, home).filter("now")
    names = came.select("tld", F.substring("day", 1, 7).alias("month"), F.concat(F.lit("customer-"), "domain", F.lit(".com")).alias("domain"), "day")
    halves = [attribution.bottom_k(names.filter(side), _KEPT) for side in (F.col("day") < "2024-01-16", F.col("day") >= "2024-01-16")]
    kept = attribution.weighted(attribution.merge(halves, _KEPT), _KEPT)
    found = attribution.attributed(kept, rdap_answers(spark, sf_dir)).withColumn("attributed", F.col("registrar_iana_id").isNotNull())
    out = attribution.estimates(found, "attributed")
    return out.withColumns({c: F.round(c, 6) for c in ("estimate", "error")})


@query(
    """WITH a AS (SELECT DISTINCT event_type AS tld, user_id FROM events WHERE ts < TIMESTAMP '2024-01-16'),
    b AS (SELECT DISTINCT event_type AS tld, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16')
    SELECT coalesce(a.tld, b.tld) AS tld, CAST(count(b.user_id) AS BIGINT) AS registered_total,
      CAST(count(*) FILTER (a.user_id IS NULL) AS BIGINT) AS new_today, CAST(count(*) FILTER (b.user_id IS NULL) AS BIGINT) AS dropped_today
    FROM a FULL JOIN b ON a.tld = b.tld AND a.user_id = b.user_id GROUP BY 1"""
)
def zone_diff_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the first half of the month against those of the second."""
    seen = snapshots(spark, sf_dir)
    first = F.col("snap_date") < "2024-01-16"
    return zones.zone_diff(seen.filter(first), seen.filter(~first))
