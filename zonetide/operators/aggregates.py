"""Counters over probed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import MAX_LENGTH, USAGE_ACTIVE, USAGE_NONE, USAGE_PARKED
from ..functions.numbers import count_if, label_space

COUNTERS = ["tracked_count", "unregistered_found", "unused_found"]


def unused() -> Column:
    """Registered, but without a site of its own."""
    return F.col("registered") & F.col("usage_state").isin(USAGE_NONE, USAGE_PARKED)


def _counts(extra_active: bool = False) -> list[Column]:
    out = [
        F.count("*").alias("tracked_count"),
        count_if(~F.col("registered")).alias("unregistered_found"),
        count_if(unused()).alias("unused_found"),
    ]
    if extra_active:
        active = F.col("registered") & (F.col("usage_state") == USAGE_ACTIVE)
        out.append(count_if(active).alias("active_found"))
    return out


def probe_cells(probes: DataFrame) -> DataFrame:
    """Finest counters: one row per (mode, TLD, length).

    Every published aggregate is a sum of these, so the names are read and shuffled once and
    all roll-ups run over a table whose size depends on TLDs x lengths alone.
    """
    return probes.groupBy("mode", "tld", "length").agg(*_counts(extra_active=True))


def _sums(*names: str) -> list[Column]:
    return [F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in names]


def global_totals(cells: DataFrame) -> DataFrame:
    """Names tracked; the 24-hour figure is the same counter, kept per UTC date downstream."""
    total = F.coalesce(F.sum("tracked_count"), F.lit(0).cast("bigint"))
    return cells.agg(total.alias("domains_tracked_lifetime"), total.alias("domains_tracked_24h"))


def _length_groups(cells: DataFrame, *keys: str) -> DataFrame:
    short = cells.filter(F.col("mode") == "short")
    return (
        short.groupBy(*keys)
        .agg(*_sums(*COUNTERS))
        .select(*keys, label_space(F.col("length")).alias("total_possible"), *COUNTERS)
    )


def length_stats(cells: DataFrame) -> DataFrame:
    """Per length over all TLDs; enumerated names only."""
    return _length_groups(cells, "length")


def length_stats_by_tld(cells: DataFrame) -> DataFrame:
    return _length_groups(cells, "tld", "length")


def tld_stats(cells: DataFrame) -> DataFrame:
    """Per TLD over enumerated names and words."""
    short = F.col("length") <= MAX_LENGTH

    def short_sum(name: str) -> Column:
        return F.sum(F.when(short, F.col(name)).otherwise(0)).cast("bigint")

    return cells.groupBy("tld").agg(
        F.sum("tracked_count").alias("domains_checked_total"),
        short_sum("tracked_count").alias("short_domains_checked_total"),
        short_sum("unregistered_found").alias("short_unregistered_count"),
        short_sum("unused_found").alias("short_no_website_count"),
        short_sum("active_found").alias("short_active_site_count"),
    )


def all_aggregates(cells: DataFrame) -> DataFrame:
    """Global, length, TLD x length and TLD groups together, told apart by ``level``.

    The grouping sets expand the cells, not the names. Length groups count enumerated names
    only and vanish where there are none.
    """
    short = F.col("mode") == "short"
    with_length = F.grouping("length") == 0
    picked = cells.groupingSets([[], ["length"], ["tld", "length"], ["tld"]], "tld", "length").agg(
        F.when(F.grouping("tld") == 0, F.when(with_length, "tld_length").otherwise("tld"))
        .otherwise(F.when(with_length, "length").otherwise("global"))
        .alias("level"),
        *[F.sum(n).alias(f"{n}_both") for n in COUNTERS],
        *[F.sum(F.when(short, F.col(n))).alias(f"{n}_short") for n in COUNTERS],
    )
    lengthy = F.col("level").isin("length", "tld_length")
    merged = picked.select(
        "level",
        "tld",
        "length",
        *[F.when(lengthy, F.col(f"{n}_short")).otherwise(F.col(f"{n}_both")).alias(n) for n in COUNTERS],
    )
    return merged.filter(F.col("tracked_count").isNotNull())


def word_pos_stats(probes: DataFrame, pos_index: DataFrame) -> DataFrame:
    """Per part of speech and length over dictionary words.

    Names are counted per label before the dictionary join, so a label that makes up much of
    the input meets the dictionary as a single row.
    """
    per_label = probes.filter(F.col("mode") == "words").groupBy("label").agg(*_counts())
    return (
        per_label.join(pos_index.withColumnRenamed("word", "label"), "label")
        .groupBy("pos", F.length("label").alias("length"))
        .agg(*_sums(*COUNTERS))
    )


def batch_summary(lengths: DataFrame) -> DataFrame:
    """Total and ``L7=54, L8=12`` text of a block's length rows (at most one row per length)."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("tracked_count") > 0, F.struct("length", "tracked_count"))))
    parts = F.transform(pairs, lambda p: F.concat(F.lit("L"), p["length"], F.lit("="), p["tracked_count"]))
    return lengths.agg(
        F.coalesce(F.sum("tracked_count"), F.lit(0).cast("bigint")).alias("total_tracked"),
        F.when(F.size(pairs) > 0, F.array_join(parts, ", ")).otherwise("none").alias("lengths"),
    )


def run_summary(blocks: DataFrame) -> DataFrame:
    """Blocks, names and failed uploads per run, and the resulting status.

    ``blocks`` has (run_id, domains, uploaded, timed_out).
    """
    return (
        blocks.groupBy("run_id")
        .agg(
            F.count("*").alias("blocks"),
            F.sum("domains").cast("bigint").alias("domains_processed"),
            count_if(~F.col("uploaded")).alias("upload_failures"),
            F.bool_or("timed_out").alias("timed_out"),
        )
        .withColumn("status", run_status(F.col("upload_failures"), F.col("timed_out")))
    )


def run_status(upload_failures: Column, timed_out: Column) -> Column:
    return F.when((upload_failures > 0) | timed_out, "partial").otherwise("success")


def with_coverage(lengths: DataFrame) -> DataFrame:
    """Share of the label space tracked; only meaningful for a single TLD, so null for ``ALL``."""
    share = F.col("tracked_count") / F.col("total_possible")
    return lengths.withColumn("coverage", F.when(F.col("tld") != "ALL", share))
