"""Stored tables as append-only batches (K13, K14, compaction).

A ledger is a Parquet folder with one ``epoch=<n>`` folder per applied batch. Writing an
epoch replaces that epoch alone, so a retried batch leaves the same table behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.upsert import MergePolicy, fold, prepare


def append(batch: DataFrame, path: str, epoch: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def create(spark: SparkSession, path: str, schema: str) -> None:
    """An empty ledger; epoch -1 carries the schema and no row."""
    append(spark.createDataFrame([], schema), path, -1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All batches with their ``epoch``; a filter on it reads only those folders."""
    return spark.read.option("basePath", path).parquet(path)


def table(ledger: DataFrame, policy: MergePolicy, seq: str = "seq") -> DataFrame:
    """Current rows of a ledger whose batches number their rows in ``seq``."""
    return fold(prepare(ledger, policy), policy, ["epoch", seq])


def latest(ledger: DataFrame, *keys: str) -> DataFrame:
    """The row of the last epoch per key, for ledgers whose batches hold whole new rows."""
    rest = [c for c in ledger.columns if c not in (*keys, "epoch")]
    last = ledger.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def compact(spark: SparkSession, path: str, policy: MergePolicy, target: str, seq: str = "seq") -> None:
    """Write the current rows as the first epoch of a new ledger; the old one is left alone."""
    rows = table(read(spark, path), policy, seq)
    append(rows.withColumn(seq, F.lit(0).cast("bigint")), target, 0)


def store_by_month(rows: DataFrame, path: str, month: str = "snap_month") -> None:
    """Write monthly rows under one folder per month; only the months in ``rows`` are replaced."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(month).parquet(path)


def read_by_month(spark: SparkSession, path: str, policy: MergePolicy) -> DataFrame:
    """Rows stored by month; a month filter reads that month's folder alone."""
    return spark.read.schema(policy.schema).parquet(path)


def export_words(words: DataFrame, path: str) -> None:
    """A word list as sorted text lines."""
    words.select("word").orderBy("word").write.mode("overwrite").text(path)
