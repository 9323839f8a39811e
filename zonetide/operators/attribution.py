"""Registrar attribution from a mergeable sample of newly registered names.

Per (TLD, month) the names with the lowest priorities are kept, a priority being a fixed hash of the name: a bottom-k sample. The sample
of a union is the sample of its parts' samples, so days, files or regions are sampled apart and merged, in any order and with
repeats, and the sample is never larger than k + 1 names a group. The priority of the first name left out says how likely each kept one
was to be kept, so what the sample finds is weighted by the inverse of that probability, with its standard error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rdap import rdap_verdicts

SAMPLE_NAMES = 400
_GROUP = ["tld", "month"]
# Priorities are the first 12 hexadecimal digits of a digest: exact in a double.
_SPACE = 16**12
# A hot TLD is reduced to its lowest priorities in that many shares before they meet.
_SHARES = 64


def priority(domain: Column | str) -> Column:
    return F.conv(F.substring(F.md5(F.col(domain) if isinstance(domain, str) else domain), 1, 12), 16, 10).cast("bigint")


def _lowest(rows: DataFrame, k: int, *within: str) -> DataFrame:
    order = Window.partitionBy(*_GROUP, *within).orderBy("priority", "domain")
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k + 1).drop("_rank")


def bottom_k(names: DataFrame, k: int = SAMPLE_NAMES) -> DataFrame:
    """(tld, month, domain, priority) of the k + 1 lowest priorities per (tld, month); the last one is only the threshold.

    A name counts once a month, however often it comes; null names are left out.
    """
    rows = names.filter("domain IS NOT NULL").select(*_GROUP, "domain", priority("domain").alias("priority")).distinct()
    shared = rows.withColumn("_share", F.pmod(F.xxhash64("domain"), F.lit(_SHARES)))
    return _lowest(_lowest(shared, k, "_share").drop("_share"), k)


def merge(samples: list[DataFrame], k: int = SAMPLE_NAMES) -> DataFrame:
    """The sample of all names that the samples were drawn from, each with the same ``k`` or a larger one."""
    out = samples[0]
    for sample in samples[1:]:
        out = out.unionByName(sample)
    return _lowest(out.select(*_GROUP, "domain", "priority").distinct(), k)


def weighted(sample: DataFrame, k: int = SAMPLE_NAMES) -> DataFrame:
    """The names kept, at most k a group, and ``chance``: how likely a name was to be kept, 1 in groups of k names or fewer."""
    group = Window.partitionBy(*_GROUP)
    rows = sample.withColumn("_rank", F.row_number().over(group.orderBy("priority", "domain")))
    threshold = F.max(F.when(F.col("_rank") == k + 1, F.col("priority"))).over(group)
    chance = F.coalesce((threshold + F.lit(0.5)) / F.lit(float(_SPACE)), F.lit(1.0))
    return rows.withColumn("chance", chance).filter(F.col("_rank") <= k).drop("_rank")


def attributed(sample: DataFrame, answers: DataFrame) -> DataFrame:
    """The sample with ``registrar_iana_id`` from captured RDAP answers, of which only those for sampled names are opened."""
    asked = answers.join(sample.select("domain").distinct(), "domain", "left_semi")
    return sample.join(rdap_verdicts(asked).select("domain", "registrar_iana_id"), "domain", "left")


def estimates(kept: DataFrame, *by: str) -> DataFrame:
    """Per (tld, month) and ``by``: names ``sampled``, the ``estimate`` of all such names, and its standard ``error``."""
    each = kept.groupBy(*_GROUP, *by).agg(F.count(F.lit(1)).alias("sampled"), F.min("chance").alias("chance"))
    return each.select(
        *_GROUP,
        *by,
        "sampled",
        (F.col("sampled") / F.col("chance")).alias("estimate"),
        (F.sqrt(F.col("sampled") * (1 - F.col("chance"))) / F.col("chance")).alias("error"),
    )
