"""Run log: lifecycle events folded to one row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import RUN_EVENTS, RUN_RUNNING, RUN_STATUSES
from ..functions.numbers import number_or_zero


def clean_events(events: DataFrame) -> DataFrame:
    """Known events of named runs; unknown finish statuses count as success, odd counts as 0."""
    status = F.when(F.col("status").isin(RUN_STATUSES), F.col("status")).otherwise("success")
    return events.filter(F.col("event").isin(RUN_EVENTS) & (F.col("run_id") != "")).withColumns(
        {
            "status": F.when(F.col("event") == "finish", status),
            "domains_processed": number_or_zero("domains_processed"),
            "errors_count": number_or_zero("errors_count"),
        }
    )


# What is known of a run, each with the place in the order of arrival that it comes from: the first start, the last counts, the
# last finish, the last notes of a finish. Parts of a run's events have facts that merge in any order.
FACTS = (
    "s struct<seq: bigint, ts: string, source: string, notes: string>, c struct<seq: bigint, domains_processed: bigint, errors_count: bigint>, "
    "f struct<seq: bigint, ts: string, status: string>, n struct<seq: bigint, notes: string>"
)


def run_facts(events: DataFrame) -> DataFrame:
    """(run_id, s, c, f, n) from cleaned events with an arrival ``seq`` and ``ts``."""
    is_start = F.col("event") == "start"
    is_finish = F.col("event") == "finish"

    def last(condition: Column, *fields: str) -> Column:
        return F.max_by(F.struct("seq", *fields), F.when(condition, F.col("seq")))

    return events.groupBy("run_id").agg(
        F.min_by(F.struct("seq", "ts", "source", "notes"), F.when(is_start, F.col("seq"))).alias("s"),
        last(~is_start, "domains_processed", "errors_count").alias("c"),
        last(is_finish, "ts", "status").alias("f"),
        last(is_finish & F.col("notes").isNotNull(), "notes").alias("n"),
    )


def merge_facts(facts: DataFrame) -> DataFrame:
    """One row per run from the facts of any parts of its events."""
    latest = [F.max_by(name, F.col(f"{name}.seq")).alias(name) for name in ("c", "f", "n")]
    return facts.groupBy("run_id").agg(F.min_by("s", F.col("s.seq")).alias("s"), *latest)


def runs_of(facts: DataFrame) -> DataFrame:
    """One row per started run. The first start makes the run; heartbeats and finishes count only after it."""
    started = facts.filter(F.col("s").isNotNull())

    def after_start(part: str, name: str) -> Column:
        return F.when(F.col(f"{part}.seq") > F.col("s.seq"), F.col(f"{part}.{name}"))

    zero = F.lit(0).cast("bigint")
    return started.select(
        "run_id",
        F.col("s.ts").alias("started_at"),
        after_start("f", "ts").alias("finished_at"),
        F.coalesce(after_start("f", "status"), F.lit(RUN_RUNNING)).alias("status"),
        F.coalesce(after_start("c", "domains_processed"), zero).alias("domains_processed"),
        F.coalesce(after_start("c", "errors_count"), zero).alias("errors_count"),
        F.col("s.source").alias("source"),
        F.coalesce(after_start("n", "notes"), F.col("s.notes")).alias("notes"),
    )


def fold_runs(events: DataFrame) -> DataFrame:
    """One row per started run, from cleaned events with an arrival ``seq`` and ``ts``.

    As the last heartbeat or finish is after the start whenever any is, first and last events are all that is
    needed: plain aggregates, which fold map-side and work the same on a stream.
    """
    return runs_of(run_facts(events))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that finished, or else started, last; none gives no row. Ties go to the higher id."""
    at = F.coalesce("finished_at", "started_at")
    return runs.withColumn("last_run_at", at).orderBy(F.desc("last_run_at"), F.desc("run_id")).limit(1)
