"""TLD dimension, company corpus and registrar reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ...functions.fixed import SPECIAL_TLDS
from ...functions.text import normalize_domain
from ...functions.times import month_of, report_months
from ...operators import corpus, registrars
from ...operators.positions import with_position
from ...operators.shares import rank_tiers as rank_tier_names
from ...plans.jobs import build_corpus, build_tld_dimension, ingest_registrar_reports
from ...session import scratch_path
from ...sources import companies, lists
from .names import HOSTS_SQL
from .registry import query, table

# ---- TLDs: every dot-separated part of a page host is listed, host TLDs have zone files --


def _host_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(F.split(normalize_domain("url"), r"\.").alias("parts"))
    two = F.transform("parts", lambda p: F.substring(p, 1, 2))
    return hosts.select(F.explode(F.concat("parts", two, F.array(F.lit("# comment"), F.lit(" ")))).alias("value")).distinct()


def _zone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(normalize_domain("url").alias("h"))
    return hosts.select(F.concat(F.upper(F.substring_index("h", ".", -1)), F.lit("\tregistry\t")).alias("value"))


_SPECIAL_SQL = ", ".join(f"('{t}', '{k}', '{j}')" for t, (k, j) in SPECIAL_TLDS.items())


@query(
    rf"""WITH h AS ({HOSTS_SQL}),
    parts AS (SELECT DISTINCT unnest(list_concat(string_split(domain, '.'), list_transform(string_split(domain, '.'), lambda p: substr(p, 1, 2)))) AS tld FROM h),
    zones AS (SELECT DISTINCT split_part(domain, '.', -1) AS z FROM h),
    special(t, kind, place) AS (VALUES {_SPECIAL_SQL})
    SELECT tld,
      CASE WHEN kind IS NOT NULL THEN kind WHEN regexp_matches(tld, '^\p{{L}}{{2}}$') THEN 'ccTLD' ELSE 'gTLD' END AS type,
      CASE WHEN place IS NOT NULL THEN place WHEN regexp_matches(tld, '^\p{{L}}{{2}}$') THEN upper(tld) ELSE 'INT' END AS jurisdiction,
      z IS NOT NULL AS in_czds, 'active' AS status
    FROM parts LEFT JOIN zones ON z = tld LEFT JOIN special ON t = tld WHERE tld <> ''"""
)
def tld_dim_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _host_parts(spark, sf_dir).withColumn("value", F.concat(F.lit(" "), F.upper("value"), F.lit("\t")))
    return build_tld_dimension(lines, _zone_lines(spark, sf_dir))


@query(f"WITH h AS ({HOSTS_SQL}) SELECT DISTINCT split_part(domain, '.', -1) AS tld FROM h")
def zone_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.zone_available(_zone_lines(spark, sf_dir))


# ---- companies: customers with a CIK and a ticker; two share classes per name ------

_TICKERS_SQL = """
  WITH t AS (SELECT c_custkey AS pos, upper(substr(c_mktsegment, 1, 3)) || '-' || (c_custkey // 2) AS ticker,
               c_name AS name, CAST(c_custkey AS VARCHAR) AS cik FROM customer),
  o AS (SELECT CAST(s_suppkey * 3 AS VARCHAR) AS k, 'https://www.' || lower(replace(s_name, '#', '-')) || '.net/x?y' AS d FROM supplier
        UNION ALL SELECT lower(upper(substr(c_mktsegment, 1, 3)) || '-' || (c_custkey // 2)), 'by-ticker-' || c_nationkey || '.org'
        FROM customer WHERE c_custkey % 10 = 4),
  r AS (SELECT t.*, coalesce(a.d, b.d) AS d FROM t LEFT JOIN o a ON a.k = cik LEFT JOIN o b ON b.k = lower(ticker)),
  n AS (SELECT pos, ticker, name, cik, CASE WHEN d IS NULL THEN regexp_replace(lower(ticker), '[^a-z0-9]', '', 'g') || '.com'
          ELSE split_part(split_part(regexp_replace(regexp_replace(d, '^https?://', ''), '^www\\.', ''), '/', 1), '?', 1) END AS canonical_domain FROM r),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_domain ORDER BY pos) AS rn FROM n) WHERE rn = 1),
  listed AS (SELECT DISTINCT upper(substr(c_mktsegment, 1, 3)) || '-' || (c_custkey // 2) AS ticker
             FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
"""


def _ticker() -> Column:
    return F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), F.lit("-"), F.expr("c_custkey div 2").cast("string"))


def ticker_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small ticker document per customer, beside an entry that is no object and a blank one."""
    entry = F.to_json(
        F.create_map(
            F.col("c_custkey").cast("string"),
            F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit(" "), _ticker()).alias("ticker"), F.col("c_name").alias("title")),
        )
    )
    padded = F.concat(F.expr("substring(_e, 1, length(_e) - 1)"), F.lit(',"a":5,"b":{"cik_str":1,"ticker":" ","title":"x"}}'))
    return table(spark, sf_dir, "customer").select("c_custkey", entry.alias("_e")).select(F.col("c_custkey"), padded.alias("value"))


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pos"), _ticker().alias("ticker"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("cik")
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_cik = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 3).cast("string").alias("key"),
        F.concat(F.lit("https://www."), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".net/x?y")).alias("domain"),
    )
    by_ticker = (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_custkey") % 10 == 4)
        .select(F.lower(_ticker()).alias("key"), F.concat(F.lit("by-ticker-"), F.col("c_nationkey").cast("string"), F.lit(".org")).alias("domain"))
    )
    return by_cik.unionByName(by_ticker)


def listed_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000))
    buyers = table(spark, sf_dir, "customer").join(urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return buyers.select(_ticker().alias("ticker")).distinct()


@query(_TICKERS_SQL + "SELECT pos AS c_custkey, ticker, name, cik FROM t")
def ticker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = companies.ticker_rows(ticker_documents(spark, sf_dir))
    return entries.select(F.col("cik").cast("bigint").alias("c_custkey"), "ticker", "name", "cik")


@query(_TICKERS_SQL + "SELECT pos, ticker, canonical_domain FROM n")
def override_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.resolve_domains(tickers(spark, sf_dir), overrides(spark, sf_dir))
    return found.select("pos", "ticker", "canonical_domain")


@query(
    _TICKERS_SQL
    + """SELECT name, canonical_domain, f.ticker, lpad(cik, CAST(greatest(length(cik), 10) AS INTEGER), '0') AS sec_cik,
      l.ticker IS NOT NULL AS in_sp500, true AS in_russell3000 FROM f LEFT JOIN listed l ON l.ticker = f.ticker"""
)
def company_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.company_rows(tickers(spark, sf_dir), overrides(spark, sf_dir))
    flagged = corpus.index_membership(rows, listed_tickers(spark, sf_dir))
    return flagged.select("name", "canonical_domain", "ticker", "sec_cik", "in_sp500", "in_russell3000")


@query(
    _TICKERS_SQL
    + """SELECT CAST(count(*) AS BIGINT) AS in_us_public, CAST(count(*) FILTER (ticker IN (FROM listed)) AS BIGINT) AS in_sp500,
      CAST(0 AS BIGINT) AS in_russell1000, CAST(count(*) AS BIGINT) AS in_russell3000 FROM f"""
)
def membership_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.company_rows(tickers(spark, sf_dir), overrides(spark, sf_dir))
    return corpus.membership_counts(corpus.index_membership(rows, listed_tickers(spark, sf_dir)))


_SITES_SQL = """
  , s AS (SELECT DISTINCT split_part(split_part(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/', 1), '?', 1) AS d
          FROM pages UNION SELECT lower(substr(c_mktsegment, 1, 3)) || (c_custkey // 2) || '.com' FROM customer JOIN orders ON o_custkey = c_custkey)
"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page hosts and the guessed domains of buying customers, all ranked within the limit."""
    hosts = table(spark, sf_dir, "pages").select(F.col("url").alias("domain"))
    buyers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"
    )
    guessed = buyers.select(F.concat(F.lower(F.substring("c_mktsegment", 1, 3)), F.expr("c_custkey div 2").cast("string"), F.lit(".com")).alias("domain"))
    rows = hosts.unionByName(guessed).withColumn("rank", F.lit(" 7 "))
    return companies.site_ranks(rows, "2026-10")


@query(
    _TICKERS_SQL
    + _SITES_SQL
    + "SELECT d AS name, d AS canonical_domain, false AS in_us_public FROM s WHERE d NOT IN (SELECT canonical_domain FROM f)"
)
def sites_not_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.company_rows(tickers(spark, sf_dir), overrides(spark, sf_dir))
    return corpus.site_only_rows(_ranks(spark, sf_dir), rows).select("name", "canonical_domain", "in_us_public")


@query(
    _TICKERS_SQL
    + _SITES_SQL
    + """SELECT name, canonical_domain, f.ticker, true AS in_us_public, l.ticker IS NOT NULL AS in_sp500
      FROM f LEFT JOIN listed l ON l.ticker = f.ticker
    UNION ALL SELECT d, d, NULL, false, false FROM s WHERE d NOT IN (SELECT canonical_domain FROM f)"""
)
def company_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = build_corpus(
        tickers(spark, sf_dir), overrides(spark, sf_dir), listed_tickers(spark, sf_dir), _ranks(spark, sf_dir)
    )
    return built.companies.select("name", "canonical_domain", "ticker", "in_us_public", "in_sp500")


# ---- ranked sites: customers by spend ---------------------------------------------


@query(
    """WITH s AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_custkey),
    r AS (SELECT 'customer-' || o_custkey || '.com' AS domain, row_number() OVER (ORDER BY cents DESC, o_custkey) AS rank FROM s)
    SELECT domain, rank, rank <= 100 AS top100, rank <= 1000 AS top1000, rank <= 10000 AS top10000 FROM r"""
)
def rank_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        (-F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))).alias("_less")
    )
    placed = with_position(spend, "_less", "o_custkey")
    rows = placed.select(
        F.concat(F.lit("WWW.Customer-"), F.col("o_custkey").cast("string"), F.lit(".com/")).alias("domain"),
        (F.col("pos") + 1).cast("string").alias("rank"),
    )
    ranked = companies.site_ranks(rows, "2026-10").withColumn("tiers", rank_tier_names())
    flags = [F.array_contains("tiers", f"tranco{n}").alias(f"top{n}") for n in (100, 1000, 10000)]
    return ranked.select("domain", "rank", *flags)


# ---- registrar reports: line items by ship month, supplier and part brand -----------

_MONTHLY_SQL = """
  WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS report_month, l_suppkey AS iana_id, lower(p_brand) AS tld,
      CAST(sum(l_quantity) AS BIGINT) AS net_adds, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS renewals,
      CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS transfers, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS deletes,
      CAST(sum(l_linenumber) AS BIGINT) AS domains_under_mgmt
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_brand").alias("tld"))
    flagged = [F.sum((F.col("l_returnflag") == f).cast("bigint")).alias(n) for f, n in (("R", "renewals"), ("A", "transfers"), ("N", "deletes"))]
    return (
        items.join(brands, "l_partkey")
        .groupBy(month_of("l_shipdate").alias("report_month"), F.col("l_suppkey").alias("iana_id"), "tld")
        .agg(
            F.sum("l_quantity").cast("bigint").alias("net_adds"),
            *flagged,
            F.sum("l_linenumber").cast("bigint").alias("domains_under_mgmt"),
        )
    )


@query(_MONTHLY_SQL + "SELECT * FROM m WHERE report_month IN ('1998-10', '1998-09', '1998-08')")
def registrar_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).filter(F.col("report_month").isin(report_months("1998-12-01")))


@query(_MONTHLY_SQL + "SELECT * FROM m WHERE report_month IN ('1998-10', '1998-09', '1998-08')")
def registrar_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by way of report files: a folder per month, the header changing by month.

    The rows of all months are written; the report months due at the end of 1998 are read.
    """
    home = scratch_path(spark, "reports")
    rows = monthly(spark, sf_dir).withColumn("net_adds", F.format_number("net_adds", 0)).repartition("report_month")
    shapes = [
        {"iana_id": "IANA-ID", "tld": "TLD", "net_adds": "Net Adds 1-Year", "renewals": "Renewals", "transfers": "transfer-in", "deletes": "Deletes", "domains_under_mgmt": "DUM"},
        {"domains_under_mgmt": "end-of-month-domains", "tld": "gTLD", "deletes": "deleted", "transfers": "Transfers", "renewals": "renew", "net_adds": "net-adds", "iana_id": "registrar-id"},
    ]
    month = F.substring("report_month", 6, 2).cast("int") % 2
    for odd, names in enumerate(shapes):
        picked = rows.filter(month == odd).select("report_month", *[F.col(f).alias(h) for f, h in names.items()])
        picked.write.mode("append").partitionBy("report_month").option("header", True).csv(home)
    due = ingest_registrar_reports(spark, f"{home}/*", now="1998-12-01", month_pattern=r"report_month=(\d{4}-\d{2})")
    return due.drop("source_url")


@query(
    _MONTHLY_SQL
    + """, t AS (SELECT *, sum(net_adds) OVER w AS na, sum(domains_under_mgmt) OVER w AS du,
        lag(report_month) OVER h AS pm, lag(domains_under_mgmt) OVER h AS pd FROM m
        WINDOW w AS (PARTITION BY report_month, tld), h AS (PARTITION BY iana_id, tld ORDER BY report_month))
    SELECT report_month, iana_id, tld, net_adds, domains_under_mgmt, net_adds / CAST(na AS DOUBLE) AS net_adds_share,
      domains_under_mgmt / CAST(du AS DOUBLE) AS domains_under_mgmt_share,
      CASE WHEN pm = strftime(CAST(report_month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') THEN domains_under_mgmt - pd END AS growth,
      s_name AS registrar FROM t LEFT JOIN supplier ON s_suppkey = iana_id"""
)
def registrar_market_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("iana_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("display_name")
    )
    return registrars.market_share(monthly(spark, sf_dir), names)


@query(
    """WITH c AS (SELECT l_suppkey AS iana_id, lower(l_returnflag || l_linestatus) AS tld, l_quantity > 10 AS carries,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS first_year_cents, strftime(l_shipdate, '%Y-%m-%d') || printf(' %015d-%015d-%d', l_orderkey, l_partkey, l_linenumber) AS last_verified_at
      FROM lineitem)
    SELECT iana_id, tld, arg_max(carries, last_verified_at) AS carries, arg_max(first_year_cents, last_verified_at) AS first_year_cents,
      max(last_verified_at) AS last_verified_at FROM c GROUP BY iana_id, tld"""
)
def registrar_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrars.latest_coverage(_coverage(spark, sf_dir))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("iana_id"),
        F.lower(F.concat("l_returnflag", "l_linestatus")).alias("tld"),
        (F.col("l_quantity") > 10).alias("carries"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("first_year_cents"),
        F.concat(
            F.substring(F.col("l_shipdate").cast("string"), 1, 10),
            *[part for k, n in (("l_orderkey", 15), ("l_partkey", 15)) for part in (F.lit(" " if k == "l_orderkey" else "-"), F.lpad(F.col(k).cast("string"), n, "0"))],
            F.lit("-"),
            F.col("l_linenumber").cast("string"),
        ).alias("last_verified_at"),
    )


@query(
    """WITH c AS (SELECT l_suppkey AS iana_id, lower(l_returnflag || l_linestatus) AS tld, l_quantity > 10 AS carries,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, strftime(l_shipdate, '%Y-%m-%d') || printf(' %015d-%015d-%d', l_orderkey, l_partkey, l_linenumber) AS v
      FROM lineitem),
    l AS (SELECT iana_id, tld, CASE WHEN arg_max(carries, v) THEN arg_max(cents, v) END AS p FROM c GROUP BY iana_id, tld)
    SELECT iana_id, max(p) FILTER (tld = 'ao') AS ao, max(p) FILTER (tld = 'nf') AS nf, max(p) FILTER (tld = 'ro') AS ro FROM l GROUP BY iana_id"""
)
def registrar_price_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrars.price_matrix(registrars.latest_coverage(_coverage(spark, sf_dir)), ["ao", "nf", "ro"])
