"""Company corpus: domains for tickers, index flags, ranked sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import count_if
from ..functions.text import domain_from_ticker, normalize_domain, pad_cik

COMPANY_COLUMNS = [
    "name",
    "canonical_domain",
    "ticker",
    "exchange",
    "sec_cik",
    "industry",
    "in_us_public",
    "in_sp500",
    "in_russell1000",
    "in_russell3000",
]
_FLAGS = ["in_us_public", "in_sp500", "in_russell1000", "in_russell3000"]


def resolve_domains(tickers: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add ``canonical_domain``: override by CIK, else by ticker, else guessed.

    Override keys are unique. CIKs are looked up as written, tickers in lower case.
    """
    by_cik = overrides.select(F.col("key").alias("cik"), F.nullif("domain", F.lit("")).alias("_by_cik"))
    by_ticker = overrides.select(F.col("key").alias("_t"), F.nullif("domain", F.lit("")).alias("_by_ticker"))
    found = (
        tickers.withColumn("_t", F.lower("ticker"))
        .join(by_cik, "cik", "left")
        .join(by_ticker, "_t", "left")
        .withColumn("_o", F.coalesce("_by_cik", "_by_ticker"))
    )
    domain = F.when(F.col("_o").isNotNull(), normalize_domain("_o")).otherwise(domain_from_ticker("ticker"))
    return found.withColumn("canonical_domain", domain).drop("_t", "_by_cik", "_by_ticker", "_o")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in source order.

    A grouping with a struct minimum, not a window: each task sends one row per key.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def company_rows(tickers: DataFrame, overrides: DataFrame) -> DataFrame:
    """Public-company rows, one per domain, first ticker wins."""
    placed = first_wins(resolve_domains(tickers, overrides), ["canonical_domain"], ["pos"])
    none = F.lit(None).cast("string")
    return placed.select(
        "name",
        "canonical_domain",
        "ticker",
        none.alias("exchange"),
        pad_cik("cik").alias("sec_cik"),
        none.alias("industry"),
        F.lit(True).alias("in_us_public"),
        *[F.lit(False).alias(f) for f in _FLAGS[1:]],
    )


def index_membership(companies: DataFrame, tickers: DataFrame, normalize_class: bool = False) -> DataFrame:
    """Set ``in_sp500`` for listed tickers, and the all-public proxy flag for every row.

    Share classes are written ``BRK.B`` in one source and ``BRK-B`` in the other and do not
    match unless ``normalize_class`` is set.
    """

    def key(name: str):
        return F.replace(F.col(name), F.lit("."), F.lit("-")) if normalize_class else F.col(name)

    listed = tickers.select(key("ticker").alias("_k")).distinct().withColumn("_in", F.lit(True))
    return (
        companies.withColumn("_k", key("ticker"))
        .join(listed, "_k", "left")
        .withColumns({"in_sp500": F.col("in_sp500") | F.col("_in").isNotNull(), "in_russell3000": F.lit(True)})
        .drop("_k", "_in")
    )


def site_only_rows(ranks: DataFrame, companies: DataFrame) -> DataFrame:
    """Ranked sites that are no company yet, each once."""
    none = F.lit(None).cast("string")
    new = ranks.select(F.col("domain").alias("canonical_domain")).distinct().join(
        companies.select("canonical_domain"), "canonical_domain", "left_anti"
    )
    return new.select(
        F.col("canonical_domain").alias("name"),
        "canonical_domain",
        none.alias("ticker"),
        none.alias("exchange"),
        none.alias("sec_cik"),
        none.alias("industry"),
        *[F.lit(False).alias(f) for f in _FLAGS],
    )


def membership_counts(companies: DataFrame) -> DataFrame:
    """Rows flagged per list."""
    return companies.agg(*[count_if(F.col(f)).alias(f) for f in _FLAGS])
