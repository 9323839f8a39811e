"""Orders as batches for stored tables, merged in two steps: those before 1996, then the later ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ...functions.times import day_of, month_of
from ...operators.upsert import POLICIES
from ...session import scratch_path
from .. import merge_table
from .registry import query, table

# The order in which rows are applied, in SQL, and the last value of an expression in it.
_SEQ = "(o_orderdate >= TIMESTAMP '1996-01-01', o_orderkey)"


def _last(expression: str, name: str, where: str | None = None) -> str:
    return f"arg_max({expression}, {_SEQ}){f' FILTER ({where})' if where else ''} AS {name}"


def _through(spark: SparkSession, sf_dir: str, policy_name: str, columns: dict[str, Column]) -> DataFrame:
    """The stored table of a policy after both batches; in the end the catalog forgets it, the files stay."""
    policy = POLICIES[policy_name]
    orders = table(spark, sf_dir, "orders")
    batch = orders.select(*[c.alias(n) for n, c in columns.items()], F.col("o_orderkey").alias("seq"), "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    name, path = f"{policy_name}_{uuid.uuid4().hex}", scratch_path(spark, policy_name)
    merge_table.create(spark, name, policy, path, list(columns))
    for part in (early, ~early):
        merge_table.merge(spark, name, batch.filter(part), policy)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path).select(*[c for c in policy.schema.fieldNames() if c in columns])


def _odd(n: int) -> Column:
    return F.col("o_orderkey") % n == 0


@query(
    """SELECT 'overall' AS snap_date, lower(o_orderstatus) AS tld, o_orderpriority AS pos, o_custkey % 9 AS length,
      CAST(sum(o_custkey % 3) AS BIGINT) AS tracked_count, CAST(count(*) AS BIGINT) AS unregistered_found, CAST(sum(o_orderkey % 5) AS BIGINT) AS unused_found
    FROM orders GROUP BY ALL"""
)
def merge_word_pos_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of both batches add up (K3)."""
    return _through(
        spark, sf_dir, "word_pos_stats",
        {
            "snap_date": F.lit("overall"), "tld": F.lower("o_orderstatus"), "pos": F.col("o_orderpriority"), "length": F.col("o_custkey") % 9,
            "tracked_count": F.col("o_custkey") % 3, "unregistered_found": F.lit(1).cast("bigint"), "unused_found": F.col("o_orderkey") % 5,
        },
    )


@query(
    f"""SELECT o_custkey AS iana_id, {_last("'R ' || o_orderkey", "name")}, {_last("o_orderpriority", "display_name", "o_orderkey % 3 = 0")},
      {_last("CASE WHEN o_orderkey % 4 = 0 THEN 'revoked' ELSE 'accredited' END", "status")}, {_last("strftime(o_orderdate, '%Y-%m-%d')", "accredited_at", "o_orderkey % 5 = 0")}
    FROM orders GROUP BY o_custkey"""
)
def merge_registrar_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and status are replaced, other attributes survive where a batch has none (K5)."""
    return _through(
        spark, sf_dir, "registrar_dim",
        {
            "iana_id": F.col("o_custkey"), "name": F.concat(F.lit("R "), F.col("o_orderkey").cast("string")), "display_name": F.when(_odd(3), F.col("o_orderpriority")),
            "accredited_at": F.when(_odd(5), day_of("o_orderdate")), "status": F.when(_odd(4), "revoked"),
        },
    )


@query(
    f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS snap_date, lower(o_orderstatus) AS tld, {_last("o_orderkey", "registered_total")},
      {_last("CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END", "new_today")}, CAST(0 AS BIGINT) AS dropped_today,
      {_last("o_custkey", "zone_size_bytes", "o_orderkey % 2 = 0")}, {_last("CASE WHEN o_orderkey % 4 = 0 THEN 'axfr' ELSE 'czds' END", "source")}
    FROM orders GROUP BY 1, 2"""
)
def merge_zone_diff_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's counts are replaced, missing ones by 0; its size survives (K7)."""
    return _through(
        spark, sf_dir, "zone_diff_daily",
        {
            "snap_date": day_of("o_orderdate"), "tld": F.lower("o_orderstatus"), "registered_total": F.col("o_orderkey"), "new_today": F.when(_odd(3), F.col("o_custkey")),
            "dropped_today": F.lit(None).cast("bigint"), "zone_size_bytes": F.when(_odd(2), F.col("o_custkey")), "source": F.when(_odd(4), "axfr"),
        },
    )


@query(
    f"""SELECT 'c' || o_custkey || '.com' AS canonical_domain, {_last("'Co ' || o_orderkey", "name")}, {_last("o_orderpriority", "ticker", "o_orderkey % 3 = 0")},
      {_last("o_orderkey % 2 = 0", "in_sp500")}, false AS in_russell1000, {_last("o_totalprice > 100000", "in_russell3000")}, true AS in_us_public
    FROM orders GROUP BY 1"""
)
def merge_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains in any case are one company; its name and flags are replaced, a missing flag clears it (K8)."""
    domain = F.concat(F.when(_odd(2), "C").otherwise("c"), F.col("o_custkey").cast("string"), F.when(_odd(3), ".COM").otherwise(".com"))
    return _through(
        spark, sf_dir, "companies",
        {
            "name": F.concat(F.lit("Co "), F.col("o_orderkey").cast("string")), "canonical_domain": domain, "ticker": F.when(_odd(3), F.col("o_orderpriority")),
            "in_sp500": F.when(_odd(2), F.lit(True)), "in_russell1000": F.lit(None).cast("boolean"), "in_russell3000": F.col("o_totalprice") > 100000, "in_us_public": F.lit(True),
        },
    )


@query(f"""SELECT 'd' || o_custkey || '.com' AS domain, strftime(o_orderdate, '%Y-%m') AS snap_month, {_last("o_orderkey", "rank")} FROM orders GROUP BY 1, 2""")
def merge_site_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rank of a domain in a month stands (K9)."""
    domain = F.concat(F.when(_odd(2), "D").otherwise("d"), F.col("o_custkey").cast("string"), F.lit(".com"))
    return _through(spark, sf_dir, "tranco_ranks", {"domain": domain, "snap_month": month_of("o_orderdate"), "rank": F.col("o_orderkey")})


@query(
    f"""SELECT 'p' || o_custkey AS provider_key, {_last("o_orderstatus", "category")}, {_last("o_orderpriority", "display_name")},
      {_last("'p' || (o_orderkey % 7)", "parent", "o_orderkey % 3 = 0")}, {_last("'n' || o_orderkey", "notes", "o_orderkey % 10 = 0")}
    FROM orders GROUP BY 1"""
)
def merge_provider_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and display name are replaced, parent and notes survive."""
    numbered = F.concat(F.lit("p"), F.col("o_custkey").cast("string"))
    return _through(
        spark, sf_dir, "provider_dim",
        {
            "provider_key": numbered, "category": F.col("o_orderstatus"), "display_name": F.col("o_orderpriority"),
            "parent": F.when(_odd(3), F.concat(F.lit("p"), (F.col("o_orderkey") % 7).cast("string"))), "notes": F.when(_odd(10), F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))),
        },
    )


@query(
    f"""SELECT strftime(o_orderdate, '%Y-%m') AS snap_month, lower(o_orderstatus) AS tier, o_orderpriority AS category, 'k' || (o_custkey % 5) AS provider_key,
      {_last("CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END", "count")}, {_last("o_orderkey", "total")}, {_last("o_custkey / CAST(o_orderkey + 1 AS DOUBLE)", "share")}
    FROM orders GROUP BY 1, 2, 3, 4"""
)
def merge_provider_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a month are replaced, missing counts by 0."""
    return _through(
        spark, sf_dir, "provider_share_monthly",
        {
            "snap_month": month_of("o_orderdate"), "tier": F.lower("o_orderstatus"), "category": F.col("o_orderpriority"), "provider_key": F.concat(F.lit("k"), (F.col("o_custkey") % 5).cast("string")),
            "count": F.when(_odd(3), F.col("o_custkey")), "total": F.col("o_orderkey"), "share": F.col("o_custkey") / (F.col("o_orderkey") + 1).cast("double"),
        },
    )
