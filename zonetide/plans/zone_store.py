"""Zone snapshots under a hash tree, so that a day is compared with another by what differs.

A name's hash puts it into a leaf, and leaves into buckets; a bucket is a folder of the day. Beside the names, a day has a digest for
each (TLD, leaf) and each (TLD, bucket): how many names, and two order-independent sums of their hashes. Days are
compared from the top: buckets with equal digests are done, in the others the leaves are compared, and only the names of leaves
that differ are read, from the folders of their buckets, and joined. Totals come from the digests alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64
# Leaves per bucket: with some tens of names a leaf, a change in a hundredth of the names leaves most leaves as they are.
LEAVES = 4096
_NODE = ["n", "d1", "d2"]


def _hash(domain: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), domain)


def _digest() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(_hash("domain", 1)).alias("d1"), F.bit_xor(_hash("domain", 2)).alias("d2")]


def store_snapshots(snapshots: DataFrame, path: str, buckets: int = BUCKETS, leaves: int = LEAVES) -> None:
    """Store days of (snap_date, tld, domain); days that are there already are replaced. A name counts once a day.

    All days of a store need the same ``buckets`` and ``leaves``."""
    place = F.pmod(_hash("domain", 0), F.lit(buckets * leaves))
    names = snapshots.select("snap_date", "tld", "domain").distinct().withColumn("leaf", place.cast("int"))
    names = names.withColumn("bucket", (F.col("leaf") % buckets).cast("int"))
    # one task a day and bucket: its folder gets one file, sorted by leaf
    dealt = names.repartition("snap_date", "bucket").sortWithinPartitions("snap_date", "bucket", "leaf", "tld")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snap_date", "bucket").parquet(f"{path}/names")
    spark = snapshots.sparkSession
    days = [r.snap_date for r in snapshots.select("snap_date").distinct().collect()]  # one row a day
    written = _names(spark, path).filter(F.col("snap_date").isin(days))
    tops = {"leaves": ["snap_date", "tld", "bucket", "leaf"], "buckets": ["snap_date", "tld", "bucket"]}
    nodes = written.groupBy(*tops["leaves"]).agg(*_digest())
    _overwrite(nodes, f"{path}/leaves")
    below = spark.read.schema(nodes.schema).parquet(f"{path}/leaves").filter(F.col("snap_date").isin(days))
    sums = [F.sum("n").alias("n"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2")]
    _overwrite(below.groupBy(*tops["buckets"]).agg(*sums), f"{path}/buckets")


def _overwrite(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snap_date").parquet(path)


def _names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tld string, domain string, leaf int, snap_date string, bucket int").parquet(f"{path}/names")


def _nodes(spark: SparkSession, path: str, level: str) -> DataFrame:
    leaf = "leaf int, " if level == "leaves" else ""
    return spark.read.schema(f"tld string, bucket int, {leaf}n bigint, d1 bigint, d2 bigint, snap_date string").parquet(f"{path}/{level}")


def _pairs(totals: DataFrame) -> DataFrame:
    """(tld, snap_date, before): each day of a TLD and its day before; days per TLD are few."""
    days = totals.groupBy("tld").agg(F.array_sort(F.collect_set("snap_date")).alias("days"))
    steps = F.transform("days", lambda d, i: F.struct(d.alias("snap_date"), F.get("days", i - 1).alias("before")))
    return days.select("tld", F.inline(steps))


def _sides(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of each day as ``now``, and of its day before as not ``now``; ``day`` is the later one."""
    known = pairs.filter("before IS NOT NULL")
    now = rows.join(known.drop("before"), ["tld", "snap_date"], "left_semi").withColumns({"day": F.col("snap_date"), "now": F.lit(True)})
    earlier = known.select("tld", F.col("snap_date").alias("day"), F.col("before").alias("snap_date"))
    then = rows.join(earlier, ["tld", "snap_date"]).withColumn("now", F.lit(False))
    return now.drop("snap_date").unionByName(then.drop("snap_date"))


def _differing(nodes: DataFrame, pairs: DataFrame, *keys: str) -> DataFrame:
    """(tld, day, keys) of the nodes that differ between a day and the one before, or that only one of them has."""
    both = _sides(nodes.select("tld", "snap_date", *keys, F.struct(*_NODE).alias("node")), pairs)
    sides = [F.max_by("node", F.when(F.col("now") == side, 1)).alias(name) for name, side in (("new", True), ("old", False))]
    return both.groupBy("tld", "day", *keys).agg(*sides).filter(~F.col("new").eqNullSafe(F.col("old"))).select("tld", "day", *keys)


def changed_names(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """(tld, day, domain, now): names that came (``now``) or went since the TLD's day before, for all days or for some.

    The numbers of the buckets that differ reach the driver, at most as many as there are; only their folders are read."""
    tops = _nodes(spark, path, "buckets")
    pairs = _pairs(tops)
    if days is not None:
        pairs = pairs.filter(F.col("snap_date").isin(days))
        # the days compared are known before anything is read: folders of other days aren't opened
        wanted = sorted({d for r in pairs.select("snap_date", "before").distinct().collect() for d in r if d is not None})
        tops = tops.filter(F.col("snap_date").isin(wanted))
    differing = _differing(tops, pairs, "bucket")
    numbers = sorted(r.bucket for r in differing.select("bucket").distinct().collect())

    def inside(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.col("bucket").isin(numbers))
        return rows if days is None else rows.filter(F.col("snap_date").isin(wanted))

    leaves = _differing(inside(_nodes(spark, path, "leaves")), pairs, "bucket", "leaf")
    names = _sides(inside(_names(spark, path)), pairs).join(leaves, ["tld", "day", "bucket", "leaf"], "left_semi")
    seen = names.groupBy("tld", "day", "domain").agg(F.bool_or("now").alias("now"), F.bool_or(~F.col("now")).alias("before"))
    return seen.filter("now <> before").select("tld", "day", "domain", "now")


def zone_history(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """Per (day, TLD): total, new and dropped against the TLD's snapshot before; the first one differs from nothing."""
    totals = _nodes(spark, path, "buckets").groupBy("snap_date", "tld").agg(F.sum("n").alias("registered_total"))
    if days is not None:
        totals = totals.filter(F.col("snap_date").isin(days))
    moved = changed_names(spark, path, days).groupBy("tld", F.col("day").alias("snap_date"))
    moved = moved.agg(F.count_if("now").alias("new_today"), F.count_if(~F.col("now")).alias("dropped_today"))
    zero = F.lit(0).cast("bigint")
    out = totals.join(moved, ["snap_date", "tld"], "left")
    return out.select("snap_date", "tld", "registered_total", *[F.coalesce(c, zero).alias(c) for c in ("new_today", "dropped_today")])
