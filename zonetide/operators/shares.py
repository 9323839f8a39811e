"""Provider shares by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed import COMPANY_TIERS, RANK_TIERS, TIER_ALL
from ..functions.text import provider_list
from ..functions.times import previous_month

# Probe column -> (category, holds a comma-separated list).
PROVIDER_COLUMNS = {
    "ns_provider": ("ns", False),
    "mx_provider": ("mx", False),
    "hosting_provider": ("cloud", False),
    "cdn_provider": ("cdn", False),
    "cert_issuer": ("cert", False),
    "analytics_provider": ("analytics", True),
    "tag_managers": ("tag_manager", True),
    "marketing_stack": ("marketing", True),
}
ADOPTION_FLAGS = {"dnssec": "dnssec", "ipv6": "has_aaaa", "caa": "caa_present", "mx": "has_mx"}


def _members(conditions: dict[str, Column]) -> Column:
    tiers = F.array(*[F.when(c, F.lit(t)) for t, c in conditions.items()])
    return F.array_compact(tiers)


def company_tiers() -> Column:
    """Index tiers of a company row, as an array."""
    return _members({t: F.coalesce(F.col(f), F.lit(False)) for t, f in COMPANY_TIERS.items()})


def rank_tiers(rank: str = "rank") -> Column:
    """Ranked tiers of a site rank, as an array."""
    return _members({t: F.col(rank) <= bound for t, bound in RANK_TIERS.items()})


def with_tiers(probes: DataFrame, companies: DataFrame, ranks: DataFrame) -> DataFrame:
    """Add ``tiers`` to probe rows: index flags, rank bounds of the same month, and ``all``.

    All three tables are keyed by domain (and month), one row per key, so no join key repeats.
    Ranks come first: they share the full key of the probe rows, so a folded probe table is
    already partitioned for that join. Companies are few.
    """
    flags = companies.select(F.col("canonical_domain").alias("domain"), company_tiers().alias("_c"))
    ranked = ranks.select("domain", "snap_month", rank_tiers().alias("_r"))
    none = F.array().cast("array<string>")
    joined = probes.join(ranked, ["snap_month", "domain"], "left").join(flags, "domain", "left")
    tiers = F.concat(F.coalesce("_c", none), F.coalesce("_r", none), F.array(F.lit(TIER_ALL)))
    return joined.withColumn("tiers", tiers).drop("_c", "_r")


def provider_share(
    probes: DataFrame, columns: dict[str, tuple[str, bool]] = PROVIDER_COLUMNS
) -> DataFrame:
    """Count, total and share per (month, tier, category, provider).

    ``probes`` has one row per (snap_month, domain) with its ``tiers``. Rows are counted per
    distinct tier list and column value first: names are never multiplied by the tiers they
    are in, comma-separated lists are taken apart once per distinct text, and the denominator
    comes out of the same pass as an entry without a category.
    """
    present = {n: c for n, c in columns.items() if n in probes.columns}
    entries = [F.struct(F.lit(None).cast("string").alias("category"), F.lit("").alias("value"))]
    entries += [F.struct(F.lit(c).alias("category"), F.col(n).alias("value")) for n, (c, _) in present.items()]
    per_value = (
        probes.select("snap_month", "tiers", F.explode(F.array(*entries)).alias("e"))
        .filter(F.col("e.category").isNull() | (F.col("e.value") != ""))
        .groupBy("snap_month", "tiers", "e.category", "e.value")
        .agg(F.count("*").alias("n"))
    )
    lists = [c for c, is_list in present.values() if is_list]
    keys = F.when(F.col("category").isin(lists), provider_list("value")).otherwise(F.array("value"))
    counted = (
        per_value.withColumn("provider_key", F.explode(keys))
        .withColumn("tier", F.explode("tiers"))
        .groupBy("snap_month", "tier", "category", "provider_key")
        .agg(F.sum("n").alias("count"))
    )
    month_tier = Window.partitionBy("snap_month", "tier")
    total = F.max(F.when(F.col("category").isNull(), F.col("count"))).over(month_tier)
    return (
        counted.withColumn("total", total)
        .filter(F.col("category").isNotNull())
        .withColumn("share", F.col("count") / F.col("total"))
        .select("snap_month", "tier", "category", "provider_key", "count", "total", "share")
    )


def month_over_month(shares: DataFrame) -> DataFrame:
    """Add ``delta_count`` and ``delta_share`` against the calendar month before.

    Null where that month has no row. Groups hold one row per month.
    """
    history = Window.partitionBy("tier", "category", "provider_key").orderBy("snap_month")
    before = F.lag(F.struct("snap_month", "count", "share")).over(history)
    adjacent = F.col("_b.snap_month") == previous_month("snap_month")
    return (
        shares.withColumn("_b", before)
        .withColumns(
            {
                "delta_count": F.when(adjacent, F.col("count") - F.col("_b.count")),
                "delta_share": F.when(adjacent, F.col("share") - F.col("_b.share")),
            }
        )
        .drop("_b")
    )


def adoption_rates(probes: DataFrame, flags: dict[str, str] = ADOPTION_FLAGS) -> DataFrame:
    """Share of names with DNSSEC, IPv6, CAA and MX per month and tier.

    Unknown (null) flags count neither way.
    """
    sums = []
    for name, column in flags.items():
        sums.append(F.sum(F.col(column).cast("bigint")).alias(f"_{name}_yes"))
        sums.append(F.count(F.col(column)).alias(f"_{name}_known"))
    per_list = probes.groupBy("snap_month", "tiers").agg(*sums)
    rolled = (
        per_list.withColumn("tier", F.explode("tiers"))
        .groupBy("snap_month", "tier")
        .agg(*[F.sum(f"_{n}_{k}").alias(f"_{n}_{k}") for n in flags for k in ("yes", "known")])
    )
    rates = [
        F.when(F.col(f"_{n}_known") > 0, F.col(f"_{n}_yes") / F.col(f"_{n}_known")).alias(f"{n}_rate") for n in flags
    ]
    return rolled.select("snap_month", "tier", *rates)


def modal_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent non-null value per key, the lowest on ties (X8). Counted before it is compared."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))
