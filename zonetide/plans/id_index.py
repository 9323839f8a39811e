"""Which upload ids were applied: a hash-bucketed index beside the ledger.

An epoch adds one segment, a Parquet folder with a folder per bucket of the ids' hash. ``MERGED`` segments of a level become
one of the next, so a bucket has a few files per level and the number of levels grows with the logarithm of the epochs. A
micro-batch reads the buckets of its own ids and nothing else; with few runs in it, the bloom filters and dictionaries of the run
ids also skip row groups. Every row has its epoch: a batch that is tried again doesn't meet itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

IDS = ["run_id", "batch_id"]
BUCKETS = 64
MERGED = 8
# So many run ids are looked up by value; Spark passes a longer list on to Parquet as a range only.
RUNS_PUSHED = 10
_SCHEMA = "run_id string, batch_id string, epoch bigint, bucket int"


class Segment(NamedTuple):
    """Ids of the epochs ``first`` to ``last``."""

    level: int
    first: int
    last: int

    def folder(self, index: str) -> str:
        return f"{index}/segment-{self.level}-{self.first}-{self.last}"


def bucket_of(run: Column | str = "run_id", batch: Column | str = "batch_id") -> Column:
    return F.pmod(F.xxhash64(run, batch), F.lit(BUCKETS)).cast("int")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def segments(spark: SparkSession, index: str) -> list[Segment]:
    """The complete segments that together hold all ids, in order.

    A merged segment counts once it is written as a whole; parts of it that are still there are left out."""
    files, target = _files(spark, index)
    if not files.exists(target):
        return []
    found = []
    for status in files.listStatus(target):
        name = status.getPath().getName()
        if name.startswith("segment-") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{index}/{name}/_SUCCESS")):
            found.append(Segment(*map(int, name.split("-", 1)[1].rsplit("-", 2))))
    kept: list[Segment] = []
    for segment in sorted(found, key=lambda s: (s.first, -s.last, -s.level)):
        if not kept or segment.last > kept[-1].last:
            kept.append(segment)
    return kept


def _write(ids: DataFrame, folder: str, level: int) -> None:
    # one task and one file a bucket, however many tasks the ids come from
    writer = ids.select(*IDS, "epoch", bucket_of().alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", *IDS).write.mode("overwrite")
    if level:
        for name in IDS:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.partitionBy("bucket").parquet(folder)


def _read(spark: SparkSession, index: str, some: list[Segment]) -> DataFrame:
    """Rows of segments; their buckets are partitions of each."""
    out = spark.createDataFrame([], _SCHEMA)
    for k, segment in enumerate(some):
        rows = spark.read.schema(_SCHEMA).parquet(segment.folder(index))
        out = rows if k == 0 else out.unionByName(rows)
    return out


def add(ids: DataFrame, index: str, epoch: int) -> None:
    """Index the ids (run_id, batch_id) that an epoch applied; what an earlier try of this epoch left is replaced.

    Then merge: as long as the last ``MERGED`` segments have one level, they become a segment of the next."""
    spark = ids.sparkSession
    _write(ids.withColumn("epoch", F.lit(epoch).cast("bigint")), Segment(0, epoch, epoch).folder(index), 0)
    while True:
        now = segments(spark, index)
        last = now[-MERGED:]
        if len(last) < MERGED or len({s.level for s in last}) > 1:
            return
        whole = Segment(last[0].level + 1, last[0].first, last[-1].last)
        _write(_read(spark, index, last), whole.folder(index), whole.level)
        for part in last:
            files, target = _files(spark, part.folder(index))
            files.delete(target, True)


def build(applied: DataFrame, index: str, last: int) -> None:
    """Index a ledger that has none yet, up to epoch ``last``."""
    _write(applied.select(*IDS, "epoch"), Segment(99, 0, last).folder(index), 99)


def lookup(asked: DataFrame, index: str, before: int) -> DataFrame:
    """Rows of the index, of epochs before ``before``, among which all ids of ``asked`` are that were applied.

    The buckets to open come from the ids asked for: at most ``BUCKETS`` numbers reach the driver, and ``RUNS_PUSHED`` run ids."""
    spark = asked.sparkSession
    wanted = [r.bucket for r in asked.select(bucket_of().alias("bucket")).distinct().collect()]
    runs = [r.run_id for r in asked.select("run_id").distinct().limit(RUNS_PUSHED + 1).collect()]
    rows = _read(spark, index, segments(spark, index)).filter(F.col("bucket").isin(wanted) & (F.col("epoch") < before))
    return rows.filter(F.col("run_id").isin(runs)) if len(runs) <= RUNS_PUSHED else rows


def clear(spark: SparkSession, index: str) -> None:
    files, target = _files(spark, index)
    files.delete(target, True)
