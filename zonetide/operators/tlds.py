"""TLD dimension."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import SPECIAL_TLDS
from ..functions.text import col


def classify_tld(tld: Column | str) -> Column:
    """Struct (type, jurisdiction). The 16 special TLDs are a literal map, so nothing is joined."""
    tld = col(tld)
    pairs = [(F.lit(t), F.struct(F.lit(k).alias("type"), F.lit(j).alias("jurisdiction"))) for t, (k, j) in SPECIAL_TLDS.items()]
    special = F.element_at(F.create_map(*chain.from_iterable(pairs)), tld)
    country = tld.rlike(r"^\p{L}{2}\z")
    return F.coalesce(
        special,
        F.when(
            country & ~tld.startswith("xn--"),
            F.struct(F.lit("ccTLD").alias("type"), F.upper(tld).alias("jurisdiction")),
        ),
        F.struct(F.lit("gTLD").alias("type"), F.lit("INT").alias("jurisdiction")),
    )


def tld_rows(tlds: DataFrame, zone_available: DataFrame) -> DataFrame:
    """Rows for the TLD dimension: class, zone-file flag, status."""
    listed = zone_available.select("tld").distinct().withColumn("_in", F.lit(True))
    return (
        tlds.join(listed, "tld", "left")
        .withColumn("_class", classify_tld("tld"))
        .select(
            "tld",
            "_class.type",
            "_class.jurisdiction",
            F.col("_in").isNotNull().alias("in_czds"),
            F.lit("active").alias("status"),
        )
    )
