"""Public-company and site-rank sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed import INDEX_TABLE_PATTERN, TICKER_LINK_PATTERN
from ..functions.numbers import integer_or_null
from ..functions.text import normalize_domain, strip


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON or HTML document, read by one task; ``large_documents`` reads long ones by byte ranges."""
    return spark.read.text(path, wholetext=True)


def ticker_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """Company entries of ticker documents (object of objects), in document order.

    Entries that are no objects, or lack ticker, title or CIK, are dropped.
    """
    return ticker_entries(documents.select(F.posexplode(F.from_json(F.col(column), "map<string,string>")).alias("pos", "key", "entry")))


def ticker_entries(entries: DataFrame) -> DataFrame:
    """(pos, ticker, name, cik) from (pos, entry), an entry being JSON text."""
    entry = F.from_json("entry", "struct<cik_str string, ticker string, title string>")
    fields = entries.select("pos", entry.alias("e")).select(
        "pos",
        strip("e.ticker").alias("ticker"),
        strip("e.title").alias("name"),
        strip("e.cik_str").alias("cik"),
    )
    return fields.filter((F.col("ticker") != "") & (F.col("name") != "") & (F.col("cik") != ""))


def index_tickers(documents: DataFrame, column: str = "value") -> DataFrame:
    """Distinct tickers linked inside the constituent tables of index pages."""
    tables = documents.select(
        F.explode(F.regexp_extract_all(F.col(column), F.lit("(?s)" + INDEX_TABLE_PATTERN), 1)).alias("body")
    )
    return tables.select(
        F.explode(F.regexp_extract_all("body", F.lit(TICKER_LINK_PATTERN), 1)).alias("ticker")
    ).distinct()


def site_ranks(rows: DataFrame, snap_month: Column | str, limit: int | None = None) -> DataFrame:
    """(domain, snap_month, rank) from text ``rank`` and ``domain``; only ranks up to ``limit`` if one is given."""
    month = F.lit(snap_month) if isinstance(snap_month, str) else snap_month
    return (
        rows.select(
            normalize_domain("domain").alias("domain"),
            month.alias("snap_month"),
            integer_or_null("rank").alias("rank"),
        )
        .filter(F.col("rank").isNotNull() if limit is None else F.col("rank") <= limit)
        .filter(F.coalesce(F.col("domain"), F.lit("")) != "")
    )


def read_site_ranks(spark: SparkSession, path: str, snap_month: str, limit: int | None = None) -> DataFrame:
    """Headerless ``rank,domain`` CSV."""
    rows = spark.read.schema("rank string, domain string").csv(path)
    return site_ranks(rows, snap_month, limit)


def domain_overrides(documents: DataFrame, column: str = "value") -> DataFrame:
    """(key, domain) of a flat JSON object, both lower-cased; the last of equal keys stands."""
    pairs = documents.select(F.posexplode(F.from_json(F.col(column), "map<string,string>")).alias("pos", "k", "v"))
    return pairs.groupBy(F.lower("k").alias("key")).agg(F.lower(F.max_by("v", "pos")).alias("domain"))
