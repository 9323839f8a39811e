"""WARC: what not-modified revisits stand for.

A revisit record says that a page was as before. It is resolved by an as-of join: the latest earlier full response of the same
canonical URL. The two have to agree on a validator (entity tag; without one on both sides the modification date; without that the
payload digest); headers of the revisit that a not-modified answer may change are then merged over those of the response.

The join is two-level, so a URL with very many captures is no single task's: rows meet inside blocks of time of a URL, and only
the last response of each block is carried on to later blocks.

Records have: record_id, url, captured_at (a number that orders captures), kind ("response" or "revisit"), status, etag, last_modified,
digest, headers (a map of lower-case names). Payloads stay where they are; ``response_id`` says which to read.

Defined results: a revisit without an earlier full response is "orphan", one that disagrees is "mismatch", one that has no validator in
common is "unverified", else "resolved". Only responses of status 200 to 299 are full. A null URL or time meets nothing. Captures at the same
time are in order of kind (responses first) and id; repeated records give repeated rows. Other columns of the records are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Headers that a not-modified answer may change, a fixed list.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

BLOCK = 10_000
_CARRIED = ("record_id", "etag", "last_modified", "digest", "headers")


def canonical_url(url: Column) -> Column:
    """One spelling of a URL: no fragment, scheme, default port or trailing slash, host in lower case without ``www.``, parameters sorted."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(host, path, F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))


def _agreement(response: Column) -> Column:
    tag = lambda t: F.regexp_replace(t, "^W/", "")
    by = [(tag(F.col("etag")), tag(response["etag"])), (F.col("last_modified"), response["last_modified"]), (F.col("digest"), response["digest"])]
    out = F.lit("unverified")
    for own, other in reversed(by):
        out = F.when(own.isNotNull() & other.isNotNull(), F.when(own == other, "resolved").otherwise("mismatch")).otherwise(out)
    return F.when(response.isNull(), "orphan").otherwise(out)


def resolve(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """All revisits with ``canonical``, ``response_id``, ``outcome`` and the merged ``headers``; unless resolved, headers are the revisit's own."""
    own = [c for c in records.columns if not c.startswith("_") and c not in ("canonical", "response_id", "outcome")]
    rows = records.select(*own, canonical_url(F.col("url")).alias("canonical"))
    full = (F.col("kind") == "response") & F.col("status").between(200, 299)
    here = F.col("canonical").isNotNull() & F.col("captured_at").isNotNull()
    rows = rows.filter((F.col("kind") == "revisit") | (full & here))
    rows = rows.withColumns({"_block": F.floor(F.col("captured_at") / block), "_full": F.when(full, F.struct(*_CARRIED)), "_order": F.struct("captured_at", "kind", "record_id")})

    inside = Window.partitionBy("canonical", "_block").orderBy("captured_at", "kind", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.last("_full", ignorenulls=True).over(inside))
    lasts = rows.filter(here).groupBy("canonical", "_block").agg(F.max_by("_full", F.when(F.col("_full").isNotNull(), F.col("_order"))).alias("_last"))
    earlier = Window.partitionBy("canonical").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).select(F.col("canonical").alias("_url"), F.col("_block").alias("_at"), "_before")

    revisits = rows.filter(F.col("kind") == "revisit")
    met = revisits.join(carried, (F.col("canonical") == F.col("_url")) & (F.col("_block") == F.col("_at")), "left")
    response = F.when(here, F.coalesce("_near", "_before"))
    met = met.withColumn("_response", response).withColumn("outcome", _agreement(F.col("_response")))
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda name, _: name.isin(*PERMITTED))
    stored = F.map_filter(F.coalesce(F.col("_response.headers"), F.create_map().cast("map<string,string>")), lambda name, _: ~F.array_contains(F.map_keys(fresh), name))
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(stored, fresh)).otherwise(F.col("headers"))
    return met.select(*[c for c in own if c != "headers"], "canonical", F.col("_response.record_id").alias("response_id"), "outcome", merged.alias("headers"))


def header_lines(headers: Column) -> Column:
    """Headers as lines in order of their names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda h: F.concat(h["key"], F.lit(": "), h["value"]))), "\n")
