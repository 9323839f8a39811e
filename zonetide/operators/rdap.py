"""Captured RDAP answers -> registration and registrar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import integer_or_null
from ..functions.text import domain_tld, strip

# Lists are opened element by element, so that one of another shape spoils nothing else.
_STRINGS = "array<string>"
_ENTITY = f"struct<roles:{_STRINGS},publicIds:{_STRINGS},vcardArray:{_STRINGS}>"
_PUBLIC_ID = "struct<type:string,identifier:string>"


def _registrar(body: Column) -> Column:
    """The first entity with the registrar role, read from the raw document."""
    entities = F.from_json(body, f"struct<entities {_STRINGS}>").entities
    parsed = F.transform(entities, lambda e: F.from_json(e, _ENTITY))
    is_registrar = lambda e: F.exists(e["roles"], lambda r: F.lower(r) == "registrar")
    return F.get(F.filter(parsed, is_registrar), F.lit(0))


def with_registrar(answers: DataFrame, body: str = "body") -> DataFrame:
    """Add ``registrar_iana_id`` and ``registrar_name`` of an RDAP document (null without one)."""
    public = F.transform("_e.publicIds", lambda p: F.from_json(p, _PUBLIC_ID))
    ids = F.transform(
        F.filter(public, lambda p: F.lower(p["type"]).contains("iana")),
        lambda p: integer_or_null(p["identifier"]),
    )
    usable = F.filter(ids, lambda i: i.isNotNull())
    lines = F.transform(F.from_json(F.get("_e.vcardArray", F.lit(1)), _STRINGS), lambda p: F.from_json(p, _STRINGS))
    names = F.filter(lines, lambda p: (F.get(p, F.lit(0)) == "fn") & (F.size(p) >= 4))
    return (
        answers.withColumn("_e", _registrar(F.col(body)))
        .withColumns(
            {
                "registrar_iana_id": F.get(usable, F.size(usable) - 1),
                "registrar_name": F.get(F.get(names, F.lit(0)), F.lit(3)),
            }
        )
        .drop("_e")
    )


def endpoints_for(domains: DataFrame, endpoints: DataFrame) -> DataFrame:
    """RDAP endpoints to ask per name; none leaves nulls (J7). A name without a dot has no TLD."""
    dotted = F.when(F.col("domain").contains("."), domain_tld("domain"))
    return domains.withColumn("tld", dotted).join(endpoints, "tld", "left")


def rdap_verdicts(answers: DataFrame) -> DataFrame:
    """One verdict per name: the first endpoint, in order, that answers usably.

    404 means not registered; 200 with a JSON object means registered, with the registrar if
    the document has one; anything else falls through. No usable answer gives nulls.
    """
    is_object = strip("body").startswith("{") & F.try_parse_json("body").isNotNull()
    found = (F.col("status") == 200) & F.coalesce(is_object, F.lit(False))
    usable = (F.col("domain").contains(".")) & ((F.col("status") == 404) | found)
    first = F.min_by(
        F.struct("status", "body"), F.when(usable, F.col("endpoint_ord"))
    )
    picked = answers.groupBy("domain").agg(first.alias("_a"))
    # The document is opened once per name, after the choice.
    read = with_registrar(
        picked.select("domain", F.col("_a.status").alias("_s"), F.when(F.col("_a.status") == 200, F.col("_a.body")).alias("body"))
    )
    return read.select(
        "domain",
        F.when(F.col("_s").isNotNull(), F.col("_s") == 200).alias("registered"),
        "registrar_iana_id",
        "registrar_name",
    )


def attribution_sample(domains: DataFrame, one_in: int = 100) -> DataFrame:
    """A fixed sample of names for registrar attribution: the same names in every run and engine."""
    bucket = F.conv(F.substring(F.md5("domain"), 1, 8), 16, 10).cast("bigint")
    return domains.filter(F.pmod(bucket, F.lit(one_in)) == 0)
