"""Captured network answers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DNS_ANSWERS = "domain string, resolver string, attempt int, http_status int, body string"
HTTP_RESPONSES = "domain string, status int, content_type string, body binary, error string"
RDAP_RESPONSES = "domain string, endpoint_ord int, status int, body string"


def rdap_endpoints(documents: DataFrame, column: str = "value") -> DataFrame:
    """(tld, endpoint_ord, url) of a bootstrap document.

    A TLD named by several services keeps the endpoints of the last one.
    """
    strings = "array<string>"
    # Opened level by level: an entry of another shape drops out without spoiling the rest.
    services = F.from_json(F.col(column), f"struct<services {strings}>").services
    flat = (
        documents.select(F.posexplode(services).alias("service", "entry"))
        .select("service", F.from_json("entry", strings).alias("entry"))
        .filter(F.size("entry") >= 2)
        .select("service", *[F.from_json(F.col("entry")[i], strings).alias(n) for i, n in enumerate(["tlds", "urls"])])
        .filter(F.col("urls").isNotNull())
        .select("service", F.explode("tlds").alias("tld"), "urls")
        .filter(F.col("tld").isNotNull())
        .groupBy(F.lower("tld").alias("tld"))
        .agg(F.max_by("urls", "service").alias("urls"))
    )
    clean = F.transform(F.filter("urls", lambda u: u.isNotNull()), lambda u: F.regexp_replace(u, "/+$", ""))
    return flat.select("tld", F.posexplode(clean).alias("endpoint_ord", "url"))
