"""Read products."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import SNAP_OVERALL, STALE_AFTER_HOURS, TLD_ALL
from ..functions.times import Now, age_hours, month_window_start
from ..operators.runs import latest_run


def latest_global(global_stats: DataFrame) -> DataFrame:
    """The row of the last date, compared as text."""
    return global_stats.orderBy(F.desc("date")).limit(1)


def lifetime_total(global_stats: DataFrame) -> DataFrame:
    """Names tracked over all dates, 0 when there are none."""
    total = F.coalesce(F.sum("domains_tracked_lifetime"), F.lit(0).cast("bigint"))
    return global_stats.agg(total.alias("domains_tracked_lifetime"))


def length_counts(length_stats: DataFrame) -> DataFrame:
    """Roll-up rows by length."""
    overall = (F.col("snap_date") == SNAP_OVERALL) & (F.col("tld") == TLD_ALL)
    return length_stats.filter(overall).orderBy("length").select(
        "length", "total_possible", F.col("tracked_count").alias("tracked"), "unregistered_found", "unused_found"
    )


def tld_length_counts(length_stats: DataFrame) -> DataFrame:
    """Rows by TLD and length."""
    overall = (F.col("snap_date") == SNAP_OVERALL) & (F.col("tld") != TLD_ALL)
    return length_stats.filter(overall).orderBy("tld", "length").select(
        "tld",
        "length",
        "total_possible",
        F.col("tracked_count").alias("tracked"),
        "unregistered_found",
        "unused_found",
    )


def word_counts_report(word_pos_stats: DataFrame) -> DataFrame:
    """Roll-up rows by part of speech and length (R2)."""
    overall = (F.col("snap_date") == SNAP_OVERALL) & (F.col("tld") == TLD_ALL)
    return word_pos_stats.filter(overall).orderBy("pos", "length").select(
        "pos", "length", F.col("tracked_count").alias("tracked"), "unregistered_found", "unused_found"
    )


def _one_row(*parts: DataFrame) -> DataFrame:
    """Columns of several tables of at most one row each, side by side in one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


class Overview(NamedTuple):
    """Parts of the overview; the lists are empty while no day has been counted."""

    totals: DataFrame
    lengths: DataFrame
    tld_lengths: DataFrame
    words: DataFrame


def overview(global_stats: DataFrame, length_stats: DataFrame, word_pos_stats: DataFrame, runs: DataFrame) -> Overview:
    """Totals, latest day, length and word rows, last update and last run."""
    last = latest_run(runs).select("last_run_at", F.col("status").alias("last_run_status"))
    day = latest_global(global_stats).select("domains_tracked_24h", F.col("updated_at").alias("last_updated_at"))
    zero = F.lit(0).cast("bigint")
    totals = _one_row(lifetime_total(global_stats), day, last).select(
        "domains_tracked_lifetime",
        F.coalesce("domains_tracked_24h", zero).alias("domains_tracked_24h"),
        "last_updated_at",
        F.coalesce("last_run_at", "last_updated_at").alias("last_run_at"),
        "last_run_status",
    )
    any_day = latest_global(global_stats).select(F.lit(True).alias("_any"))
    gate = lambda df: df.filter(F.coalesce(any_day.scalar(), F.lit(False)))
    return Overview(
        totals,
        gate(length_counts(length_stats)),
        gate(tld_length_counts(length_stats)),
        gate(word_counts_report(word_pos_stats)),
    )


def provider_latest(shares: DataFrame, tier: str | None = None, category: str | None = None) -> DataFrame:
    """Rows of the latest month there is.

    The month is a scalar subquery, so a table partitioned by month reads one partition.
    """
    month = shares.agg(F.max("snap_month")).scalar()
    rows = shares.filter(F.col("snap_month") == month)
    if tier:
        rows = rows.filter(F.col("tier") == tier)
    if category:
        rows = rows.filter(F.col("category") == category)
    return rows.select(
        "snap_month", "tier", "category", "provider_key", "count", "total", "share", "delta_share"
    ).orderBy("tier", "category", F.desc("share"), "provider_key")


def provider_history(
    shares: DataFrame, tier: str, category: str, months: int | None = None, now: Now = None
) -> DataFrame:
    """Rows of one tier and category from the cutoff month on."""
    if not tier or not category:
        raise ValueError("tier and category required")
    return (
        shares.filter((F.col("tier") == tier) & (F.col("category") == category))
        .filter(F.col("snap_month") >= month_window_start(now, months))
        .select("snap_month", "provider_key", "count", "total", "share")
        .orderBy("snap_month", F.desc("share"), "provider_key")
    )


def _hours(age: Column) -> Column:
    return F.coalesce(age.cast("string"), F.lit("null"))


def freshness(runs: DataFrame, global_stats: DataFrame, now: Now = None) -> DataFrame:
    """Two checks, ``last_run`` and ``data_freshness``, one row each.

    Every check is a global aggregate, so it has its row even when its table is empty.
    """
    at = F.coalesce("finished_at", "started_at").cast("string")
    last = runs.agg(F.max_by(F.struct("run_id", "status", at.alias("at")), F.struct(at, F.col("run_id"))).alias("r"))
    run = last.select(
        F.lit("last_run").alias("name"),
        F.col("r").isNotNull().alias("known"),
        age_hours("r.at", now).alias("age_hours"),
        F.col("r.status").alias("status"),
        F.col("r.run_id").alias("run_id"),
    )
    data = global_stats.agg(F.max("updated_at").cast("string").alias("at")).select(
        F.lit("data_freshness").alias("name"),
        F.col("at").isNotNull().alias("known"),
        age_hours("at", now).alias("age_hours"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("run_id"),
    )
    age = _hours(F.col("age_hours"))
    stale = F.col("known") & (F.col("age_hours").isNull() | (F.col("age_hours") > STALE_AFTER_HOURS))
    failed = F.col("status") == "failed"
    is_run = F.col("name") == "last_run"
    subject = F.when(is_run, "run").otherwise("upload")
    # Fixed message formats.
    message = (
        F.when(~F.col("known"), F.when(is_run, "no runs recorded yet").otherwise("no aggregate data"))
        .when(stale, F.concat(F.lit("stale: "), age, F.lit("h since last "), subject, F.lit(f" (threshold {STALE_AFTER_HOURS}h)")))
        .when(failed, F.concat(F.lit("last run status=failed (run_id="), F.col("run_id"), F.lit(")")))
        .when(is_run, F.concat(F.lit("ok: "), age, F.lit("h since last "), F.col("status"), F.lit(" run")))
        .otherwise(F.concat(F.lit("ok: "), age, F.lit("h since last upload")))
    )
    ok = F.col("known") & ~stale & ~F.coalesce(failed, F.lit(False))
    return run.unionByName(data).select(
        "name", ok.alias("ok"), "age_hours", F.col("status").alias("last_run_status"), message.alias("message")
    )


def health(checks: DataFrame) -> DataFrame:
    """All checks ok, or degraded."""
    ok = F.bool_and("ok")
    return checks.agg(ok.alias("ok"), F.when(ok, "ok").otherwise("degraded").alias("status"))


def upload_document(
    date: str,
    totals: DataFrame,
    lengths: DataFrame,
    tld_lengths: DataFrame,
    words: DataFrame,
    run_id: str | None = None,
    batch_id: str | None = None,
) -> DataFrame:
    """One upload document of a block's aggregates, rows sorted, unknown ids left out.

    The document holds counters per TLD x length, whatever the number of names behind them.
    """

    def listed(df: DataFrame, name: str, keys: list[str], rest: list[str]) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*keys, *rest)))
        return df.agg(rows.alias(name))

    found = ["tracked_count", "unregistered_found", "unused_found"]
    parts = _one_row(
        totals,
        listed(lengths, "length_stats", ["length"], ["total_possible", *found]),
        listed(tld_lengths, "length_stats_by_tld", ["tld", "length"], ["total_possible", *found]),
        listed(words, "word_pos_stats", ["pos", "length"], found),
    )
    document = F.struct(
        F.lit(date).alias("date"),
        F.struct("domains_tracked_lifetime", "domains_tracked_24h").alias("global"),
        "length_stats",
        "length_stats_by_tld",
        "word_pos_stats",
        F.nullif(F.lit(run_id).cast("string"), F.lit("")).alias("run_id"),
        F.nullif(F.lit(batch_id).cast("string"), F.lit("")).alias("batch_id"),
    )
    return parts.select(F.to_json(document).alias("value"))
