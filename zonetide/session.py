"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for. Every one has a sane cluster meaning:
# partition counts come from AQE, broadcasts stay behind Spark's own size check.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}


def builder(app: str = "zonetide") -> SparkSession.Builder:
    """A session builder with the recommended settings applied."""
    out = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master may fall back to a temporary folder; on a cluster an
    unset ``spark.checkpoint.dir`` is an error, not a reason to write to one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir(spark.sparkContext.applicationId)


@lru_cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="zonetide-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread_small(df: DataFrame, bytes_at_most: int = 256 << 20) -> DataFrame:
    """Give every core a part of a small input that comes in fewer splits than there are cores.

    Worth it before work that is heavy per row. Larger inputs, and those with enough splits,
    are left where they are.
    """
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.optimizedPlan().stats().sizeInBytes() > bytes_at_most:
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for stateful streams: as many state partitions as the cluster has cores.

    A stream keeps the number it starts with for life, and each costs a store per
    micro-batch, so the setting for batch shuffles is not the one to take over.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    return session


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so later branches see one fixed set of partitions."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
