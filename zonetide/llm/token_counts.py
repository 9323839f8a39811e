"""Token counts: one exact histogram of encoded lengths answers totals, quantiles and truncated totals for every limit.

The histogram has a row per distinct length, so it is as small as the longest document allows. Sums over all longer
lengths are taken in two levels, inside blocks of lengths and over the blocks, so no task holds the whole histogram.

Defined results: a null length counts as 0, as a null or empty text has no tokens. Repeated rows count each. An empty table
has an empty histogram, no quantiles, and totals of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Lengths per block: what one task of the inner sums holds at most, and by how much the outer ones are shorter than the longest text.
BLOCK = 256


def histogram(documents: DataFrame, length: Column) -> DataFrame:
    """(length, n_docs): how many documents have each length."""
    return documents.select(F.coalesce(length, F.lit(0)).cast("long").alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """The histogram with, for each length L: ``docs_from`` and ``tokens_from`` (documents of at least L tokens, and their tokens)
    and ``truncated`` (tokens of all documents if each is cut at L)."""
    rows = lengths.withColumns({"block": F.floor(F.col("length") / BLOCK), "n_tokens": F.col("length") * F.col("n_docs")})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block of lengths
    later = blocks.select("block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("docs", "tokens")], *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in ("tokens",)])
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(later, "block")
    docs, tokens = F.sum("n_docs").over(inside) + F.col("docs_above"), F.sum("n_tokens").over(inside) + F.col("tokens_above")
    rows = rows.withColumns({"docs_from": docs, "tokens_from": tokens})
    return rows.select("length", "n_docs", "n_tokens", "docs_from", "tokens_from", (F.col("tokens_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated"))


def truncated_totals(suffixes: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens, truncated_docs): tokens left, and documents cut, at each of some context limits; from ``suffix_sums``."""
    total = suffixes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"), *[_longer(k, limit) for k, limit in enumerate(limits)])
    rows = [F.struct(F.lit(x).cast("long").alias("limit"), (F.col("all") - F.col(f"longer_{k}.over")).alias("tokens"), F.col(f"longer_{k}.docs").alias("truncated_docs")) for k, x in enumerate(limits)]
    return total.select(F.inline(F.array(*rows)))


def _longer(k: int, limit: int) -> Column:
    """Documents above the limit and the tokens they have beyond it, from the first row above it."""
    first = F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("length") > limit, F.col("length")))
    docs = F.coalesce(first["docs_from"], F.lit(0))
    return F.struct(docs.alias("docs"), (F.coalesce(first["tokens_from"], F.lit(0)) - limit * docs).alias("over")).alias(f"longer_{k}")


def quantiles(suffixes: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of documents doesn't exceed."""
    total = suffixes.agg(F.sum("n_docs").alias("total"))
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    reached = suffixes.join(F.broadcast(total), F.lit(True))  # one row
    reached = reached.select("length", (F.col("total") - F.col("docs_from") + F.col("n_docs")).alias("up_to"), "total", asked)
    return reached.filter("up_to >= share * total").groupBy("share").agg(F.min("length").alias("length"))
