"""JSON, HTML and text sources, with documents built row by row from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.numbers import number_or_zero, report_number
from ...functions.text import domain_from_ticker, normalize_domain, pad_cik, report_tld
from ...functions.times import age_hours
from ...operators import rdap
from ...operators.probes import with_label
from ...sources import batches, captures, companies
from .names import HOSTS_SQL
from .registry import query, table


# ---- RDAP: one answer per order, the customer is the name, the order the endpoint -----

_RDAP_SQL = """
  WITH a AS (SELECT o_custkey AS c, o_orderkey AS e, [404, 200, 200, 500, 200][o_orderkey % 5 + 1] AS status,
      o_orderkey % 5 = 4 AS broken, o_orderpriority AS p, o_orderkey % 4 <> 1 AS has_registrar FROM orders),
  f AS (SELECT c, arg_min(e, e) AS e FROM a WHERE status = 404 OR (status = 200 AND NOT broken) GROUP BY c)
"""


def rdap_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    role = F.when(key % 4 != 1, "Registrar").otherwise("abuse")
    body = F.concat(
        F.lit('{"entities":[{"roles":["technical"]},7,{"roles":["'),
        role,
        F.lit('"],"publicIds":[{"type":"IANA Registrar ID","identifier":"'),
        key.cast("string"),
        F.lit('"},{"type":"other","identifier":"1"}],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","'),
        F.col("o_orderpriority"),
        F.lit('"]]]}]}'),
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string"), F.lit(".com")).alias("domain"),
        key.alias("endpoint_ord"),
        F.get(F.array(*[F.lit(s) for s in (404, 200, 200, 500, 200)]), (key % 5).cast("int")).alias("status"),
        F.when(key % 5 == 4, "not json").otherwise(body).alias("body"),
    )


@query(
    _RDAP_SQL
    + """SELECT 'customer-' || x.c || '.com' AS domain, CASE WHEN a.status IS NOT NULL THEN a.status = 200 END AS registered,
      CASE WHEN a.status = 200 AND has_registrar THEN a.e END AS registrar_iana_id,
      CASE WHEN a.status = 200 AND has_registrar THEN p END AS registrar_name
    FROM (SELECT DISTINCT c FROM a) x LEFT JOIN f ON f.c = x.c LEFT JOIN a ON a.e = f.e"""
)
def rdap_registrar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdap.rdap_verdicts(rdap_answers(spark, sf_dir))


@query(
    f"""WITH h AS ({HOSTS_SQL}), n AS (SELECT DISTINCT domain, split_part(domain, '.', -1) AS tld FROM h)
    SELECT domain, tld, CAST(o AS INTEGER) AS endpoint_ord, CASE WHEN tld <> 'org' THEN 'https://rdap' || o || '.' || tld || '.example' END AS url
    FROM n JOIN (VALUES (0), (1), (NULL)) v(o) ON (tld <> 'org') = (o IS NOT NULL)"""
)
def rdap_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page hosts against a bootstrap document made of their own TLDs, one of which it lacks."""
    names = with_label(table(spark, sf_dir, "pages").select(normalize_domain("url").alias("domain"))).select("domain", "tld").distinct()
    served = names.filter(F.col("tld") != "org").select("tld").distinct()
    entry = F.concat(
        F.lit('{"services":[[["'), F.upper("tld"), F.lit('"],["old"]],[["'), F.upper("tld"), F.lit('"],["https://rdap0.'), F.col("tld"),
        F.lit('.example/","https://rdap1.'), F.col("tld"), F.lit('.example//"]],["short"]]}'),
    )
    flat = captures.rdap_endpoints(served.select(entry.alias("value")))
    return rdap.endpoints_for(names.drop("tld"), flat).select("domain", "tld", "endpoint_ord", "url")


@query(
    """WITH n AS (SELECT 'customer-' || o_orderkey || '.com' AS domain FROM orders)
    SELECT domain FROM n WHERE CAST('0x' || substr(md5(domain), 1, 8) AS BIGINT) % 100 = 0"""
)
def attribution_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer-"), F.col("o_orderkey").cast("string"), F.lit(".com")).alias("domain"))
    return rdap.attribution_sample(names)


# ---- index pages ---------------------------------------------------------------------


INDEX_TICKERS_SQL = r"""WITH d AS (SELECT replace(upper(replace(html, 'ß', '')), '</A>', '</a>') AS t FROM pages)
    SELECT DISTINCT unnest(regexp_extract_all(t, '>([A-Z][A-Z0-9.\-]{0,5})</a>', 1)) AS ticker FROM d"""


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as index pages, their text in upper case so that words of links look like tickers."""
    body = F.replace(F.upper(F.replace("html", F.lit("ß"), F.lit(""))), F.lit("</A>"), F.lit("</a>"))
    wrapped = F.concat(F.lit('<p>><a>NOT</a></p><table class="wikitable sortable">\n'), body, F.lit("</table>"))
    return table(spark, sf_dir, "pages").select(wrapped.alias("value"))


@query(INDEX_TICKERS_SQL)
def index_page_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.index_tickers(index_pages(spark, sf_dir))


# ---- row batches: one document of three rows per customer ------------------------------

_ROWS_SQL = """
  SELECT c_custkey, CAST(0 AS INTEGER) AS seq, lower(c_name) AS domain, '2026-0' || (c_custkey % 9 + 1) AS snap_month, c_custkey AS rank FROM customer
"""


def _row_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A good row, one whose rank is blank, one whose domain is a number, and a null."""
    month = F.concat(F.lit('"2026-0'), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit('"'))
    rank = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit('"'), "c_custkey", F.lit('"')))
    document = F.concat(
        F.lit('{"rows":[{"domain":"'), F.lower("c_name"), F.lit('","snap_month":'), month, F.lit(',"rank":'), rank,
        F.lit('},{"domain":"x","snap_month":'), month, F.lit(',"rank":""},{"domain":5,"snap_month":'), month, F.lit(',"rank":1},null]}'),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", document.alias("value"))


@query(_ROWS_SQL)
def row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.row_batches(_row_documents(spark, sf_dir), "tranco_ranks")[0]


@query("SELECT CAST(seq AS INTEGER) AS seq, CAST(count(*) AS BIGINT) AS n FROM customer, (VALUES (1), (2), (3)) v(seq) GROUP BY seq")
def row_batch_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = batches.row_batches(_row_documents(spark, sf_dir), "tranco_ranks")[1]
    return rejects.groupBy("seq").agg(F.count("*").alias("n"))


# ---- numbers and ages ------------------------------------------------------------------


@query(
    r"""SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 = 1 THEN 0 ELSE p_partkey * 7919 - 500 END AS BIGINT) AS parsed,
      CAST(floor(p_retailprice) AS BIGINT) AS coerced, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik,
      regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '.com' AS guessed, lower(p_type) AS tld FROM part"""
)
def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report numbers with commas or decimals, coerced prices, CIKs, guessed domains, dotted TLDs."""
    number = F.col("p_partkey") * 7919 - 500
    text = F.when(F.col("p_partkey") % 5 == 1, F.concat(number.cast("string"), F.lit(".0"))).otherwise(F.format_number(number, 0))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        report_number(F.concat(F.lit(" "), text, F.lit("\t"))).alias("parsed"),
        number_or_zero(F.col("p_retailprice").cast("string")).alias("coerced"),
        pad_cik(F.col("p_partkey").cast("string")).alias("cik"),
        domain_from_ticker("p_brand").alias("guessed"),
        report_tld(F.concat(F.lit(" .."), "p_type", F.lit("\n"))).alias("tld"),
    )


@query(
    """SELECT event_id, CAST(floor((1706745600000 - epoch_ms(ts) + (user_id % 2) * 5400000) / 3600000.0 + 0.5) AS BIGINT) AS age_hours FROM events"""
)
def utc_age_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages at 2024-02-01 of timestamps written with a blank and no zone, or a ``T`` and +01:30."""
    text = F.col("ts").cast("string")
    zoned = F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("+01:30"))
    written = F.when(F.col("user_id") % 2 == 1, zoned).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", age_hours(written, "2024-02-01").alias("age_hours"))
