"""Captured DNS and HTTP answers -> one verdict per name."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import (
    PARKING_PHRASES,
    PRODUCT_ACTIVE,
    PRODUCT_PHRASES,
    PRODUCT_UNKNOWN,
    REDIRECT_STATUSES,
    USAGE_ACTIVE,
    USAGE_NONE,
    USAGE_PARKED,
)
from ..functions.text import contains_any, domain_label, domain_tld, is_blank


def dns_verdicts(answers: DataFrame) -> DataFrame:
    """Add ``resolver_error`` and ``registered`` (null on error) to captured DNS-JSON answers."""
    parsed = answers.withColumn("_v", F.when(F.col("http_status") == 200, F.try_parse_json("body")))
    status = F.try_variant_get("_v", "$.Status", "variant")
    code = F.try_variant_get("_v", "$.Status", "double")
    n_answers = F.size(F.try_variant_get("_v", "$.Answer", "array<variant>"))
    known = status.isNotNull() & (F.schema_of_variant(status) != "VOID")
    return parsed.withColumn("resolver_error", ~F.coalesce(known, F.lit(False))).withColumn(
        "registered",
        F.when(~F.col("resolver_error"), F.coalesce((code == 0) & (n_answers > 0), F.lit(False))),
    ).drop("_v")


def resolve(verdicts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First usable answer per name in attempt order; none usable means unregistered."""
    usable = F.when(~F.col("resolver_error"), F.col("attempt"))
    first = F.min_by("registered", usable)
    return (
        verdicts.groupBy(*(keys or ["domain"]))
        .agg(first.alias("_first"))
        .withColumns(
            {
                "registered": F.coalesce(F.col("_first"), F.lit(False)),
                "resolver_error": F.col("_first").isNull(),
            }
        )
        .drop("_first")
    )


def body_text(body: Column, is_binary: bool, limit: int | None = None) -> Column:
    """Inspected part of a body as text, bytes that are no UTF-8 dropped. No limit: all of it."""
    raw = body if is_binary else F.encode(body, "UTF-8")
    if limit is None and not is_binary:
        return body
    if limit is not None:
        raw = F.substring(raw, 1, limit)
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def http_usage(
    responses: DataFrame,
    body_limit: int | None = None,
    parking: Iterable[str] = tuple(PARKING_PHRASES),
    product: Iterable[str] = tuple(PRODUCT_PHRASES),
) -> DataFrame:
    """Add ``usage_state`` and ``product_state`` to captured home-page responses."""
    binary = responses.schema["body"].dataType.typeName() == "binary"
    text = F.coalesce(body_text(F.col("body"), binary, body_limit), F.lit(""))
    failed = F.col("error").isNotNull() | (F.coalesce(F.col("status"), F.lit(0)) >= 400)
    html = F.coalesce(F.col("content_type"), F.lit("")).contains("text/html")
    usage = (
        F.when(F.col("_failed"), USAGE_NONE)
        .when(contains_any("_text", parking), USAGE_PARKED)
        .when(F.col("status").isin(REDIRECT_STATUSES), USAGE_PARKED)
        .when(html & ~is_blank("_text"), USAGE_ACTIVE)
        .otherwise(USAGE_NONE)
    )
    sells = ~F.col("_failed") & contains_any("_text", product)
    return (
        responses.withColumns({"_text": F.lower(text), "_failed": failed})
        .withColumns(
            {
                "usage_state": usage,
                "product_state": F.when(sells, PRODUCT_ACTIVE).otherwise(PRODUCT_UNKNOWN),
            }
        )
        .drop("_text", "_failed", "body")
    )


def probe_results(resolved: DataFrame, usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per name: registration, usage, product, label, length, TLD.

    Only registered names have a home page looked at; everything else keeps the defaults.
    The join is on the name alone, with registration as a condition beside it, so that the
    partitioning left by ``resolve`` serves the join as well.
    """
    keys = keys or ["domain"]
    pages = usage.select(*[F.col(k).alias(f"_{k}") for k in keys], "usage_state", "product_state")
    same = reduce(lambda a, k: a & (F.col(k) == F.col(f"_{k}")), keys, F.col("registered"))
    joined = resolved.join(pages, same, "left").drop(*[f"_{k}" for k in keys])
    return with_label(
        joined.withColumns(
            {
                "usage_state": F.coalesce(F.col("usage_state"), F.lit(USAGE_NONE)),
                "product_state": F.coalesce(F.col("product_state"), F.lit(PRODUCT_UNKNOWN)),
            }
        )
    )


def with_label(df: DataFrame, domain: str = "domain") -> DataFrame:
    label = domain_label(domain)
    return df.withColumns({"label": label, "length": F.length(label), "tld": domain_tld(domain)})


def resolver_counts(verdicts: DataFrame) -> DataFrame:
    """Usable and failed answers per resolver."""
    failed = F.col("resolver_error").cast("bigint")
    return verdicts.groupBy("resolver").agg(F.sum(1 - failed).alias("ok"), F.sum(failed).alias("err"))
