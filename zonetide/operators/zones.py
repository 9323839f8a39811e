"""Zone snapshots -> daily totals, new and dropped names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import count_if


def zone_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Per TLD: names in ``current``, and those added and gone since ``previous``.

    Both sides have (tld, domain). Presence is settled per name, so a TLD that holds most
    names is spread over as many tasks as there are names to spread.
    """
    sides = previous.select("tld", "domain", F.lit(1).alias("_side")).unionByName(
        current.select("tld", "domain", F.lit(2).alias("_side"))
    )
    names = sides.groupBy("tld", "domain").agg(
        F.bool_or(F.col("_side") == 1).alias("before"), F.bool_or(F.col("_side") == 2).alias("now")
    )
    return names.groupBy("tld").agg(
        count_if(F.col("now")).alias("registered_total"),
        count_if(F.col("now") & ~F.col("before")).alias("new_today"),
        count_if(F.col("before") & ~F.col("now")).alias("dropped_today"),
    )


def zone_history(snapshots: DataFrame) -> DataFrame:
    """Per (day, TLD): total, new and dropped against the TLD's snapshot before.

    ``snapshots`` has (snap_date, tld, domain). One shuffle of the names for the whole history:
    the days a name was seen on are gathered per name (duplicates fold map-side, at most one
    entry per day remains) and counted by the day seen before. A name that stayed since the
    last snapshot is one whose day before is that snapshot; new and dropped are the rest of
    today's and of the last total. The first snapshot of a TLD differs from nothing: 0 and 0.
    """
    seen = snapshots.groupBy("tld", "domain").agg(F.array_sort(F.collect_set("snap_date")).alias("seen"))
    steps = F.transform("seen", lambda d, i: F.struct(d.alias("snap_date"), F.get("seen", i - 1).alias("before")))
    counted = (
        seen.select("tld", F.explode(steps).alias("s"))
        .groupBy("tld", "s.snap_date", "s.before")
        .agg(F.count("*").alias("n"))
    )
    # One entry per earlier day: bounded by the number of snapshots.
    days = counted.groupBy("tld", "snap_date").agg(
        F.sum("n").alias("registered_total"), F.collect_list(F.struct("before", "n")).alias("_from")
    )
    by_day = Window.partitionBy("tld").orderBy("snap_date")
    linked = days.withColumns(
        {"_day": F.lag("snap_date").over(by_day), "_total": F.lag("registered_total").over(by_day)}
    )
    same = F.get(F.filter("_from", lambda e: e["before"] == F.col("_day")), F.lit(0))["n"]
    zero = F.lit(0).cast("bigint")
    first = F.col("_day").isNull()
    return linked.withColumn("_stayed", F.coalesce(same, zero)).select(
        "snap_date",
        "tld",
        "registered_total",
        F.when(first, zero).otherwise(F.col("registered_total") - F.col("_stayed")).alias("new_today"),
        F.when(first, zero).otherwise(F.col("_total") - F.col("_stayed")).alias("dropped_today"),
    )
