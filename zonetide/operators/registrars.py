"""Registrar market share and price coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.times import previous_month

_MEASURES = ["net_adds", "domains_under_mgmt"]


def market_share(monthly: DataFrame, registrars: DataFrame | None = None) -> DataFrame:
    """Share of net adds and of names managed per (month, TLD), and growth on the month before.

    Totals are grouped (and fold map-side) and joined back, so a TLD with most of the rows is
    never one task's window; the only window is over the months of one registrar and TLD. A
    zero total or a missing month gives null.
    """
    market = ["report_month", "tld"]
    totals = monthly.groupBy(*market).agg(*[F.sum(m).alias(f"_{m}") for m in _MEASURES])
    history = Window.partitionBy("iana_id", "tld").orderBy("report_month")
    shares = {}
    for name in _MEASURES:
        total = F.col(f"_{name}")
        shares[f"{name}_share"] = F.when(total != 0, F.col(name) / total)
    before = F.lag(F.struct("report_month", "domains_under_mgmt")).over(history)
    adjacent = F.col("_b.report_month") == previous_month("report_month")
    out = (
        monthly.select("report_month", "iana_id", "tld", *_MEASURES)
        .join(totals, market)
        .withColumns(shares)
        .drop(*[f"_{m}" for m in _MEASURES])
        .withColumn("_b", before)
        .withColumn("growth", F.when(adjacent, F.col("domains_under_mgmt") - F.col("_b.domains_under_mgmt")))
        .drop("_b")
    )
    if registrars is None:
        return out
    return out.join(registrars.select("iana_id", F.coalesce("display_name", "name").alias("registrar")), "iana_id", "left")


def latest_coverage(coverage: DataFrame) -> DataFrame:
    """The row verified last per (registrar, TLD); unverified rows count as oldest."""
    keys = ["iana_id", "tld"]
    rest = [c for c in coverage.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.coalesce(F.col("last_verified_at"), F.lit("")))
    return coverage.groupBy(*keys).agg(last.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def price_matrix(latest: DataFrame, tlds: list[str], price: str = "first_year_cents") -> DataFrame:
    """Registrars as rows and the named TLDs as columns; null where not carried."""
    carried = F.when(F.col("carries"), F.col(price))
    return latest.withColumn("_p", carried).groupBy("iana_id").pivot("tld", tlds).agg(F.max("_p"))
