"""Line-oriented lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import SPACES, is_blank, strip


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def tld_list(lines: DataFrame) -> DataFrame:
    """One lower-case TLD per line; blank lines and ``#`` comments dropped."""
    tld = F.lower(strip("value"))
    return lines.filter(~is_blank("value")).select(tld.alias("tld")).filter(~F.col("tld").startswith("#"))


def zone_available(lines: DataFrame) -> DataFrame:
    """Distinct TLDs whose zone files can be had: first token of each line."""
    token = F.split(F.col("tld"), SPACES, 2)[0]
    return tld_list(lines).select(token.alias("tld")).distinct()


def word_list(lines: DataFrame) -> DataFrame:
    """Trimmed, non-blank lines."""
    return lines.filter(~is_blank("value")).select(strip("value").alias("word"))
