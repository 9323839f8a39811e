"""Stored tables that take a batch in place: bucketed by key, and only the touched parts are rewritten.

A row's part is a hash of its key; a part is a folder of the table, and in it the rows lie in buckets of the same key. A merge
folds the batch to a row per key, reads the parts that these keys fall into, joins them bucket by bucket (the stored side is neither
shuffled nor read as a whole) and replaces those parts at once, in one commit. Parts that no key falls into aren't opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.upsert import MergePolicy, fold, prepare

PARTS = 16
BUCKETS = 8
_PART = "_part"


def _part(policy: MergePolicy) -> Column:
    return F.pmod(F.xxhash64(*policy.keys), F.lit(PARTS)).cast("int")


def create(spark: SparkSession, name: str, policy: MergePolicy, path: str, columns: list[str] | None = None) -> None:
    """A table ``name`` at ``path`` with the policy's columns, or some of them; one that is at that path already is opened.

    The catalog only holds where the table is and how it is bucketed; a session without a lasting one opens it anew."""
    kept = [f for f in policy.schema if columns is None or f.name in columns or f.name in policy.keys]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    keys = ", ".join(f"`{k}`" for k in policy.keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({types}, updated_at timestamp, {_PART} int) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
        f"PARTITIONED BY ({_PART}) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {BUCKETS} BUCKETS LOCATION '{path}'"
    )
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.catalog.recoverPartitions(name)


def rows(spark: SparkSession, name: str) -> DataFrame:
    """The table as it is now."""
    return spark.table(name).drop(_PART, "updated_at")


def merged(stored: DataFrame, batch: DataFrame, policy: MergePolicy, seq: str | list[str] = "seq") -> DataFrame:
    """``stored`` after the rows of ``batch``, applied in the order of ``seq``; both have the policy's columns, or some of them.

    A column that the batch doesn't have keeps its values. Rows of the batch with a null in their key are no rows of the table."""
    batch = prepare(batch, policy)
    for key in policy.keys:
        batch = batch.filter(F.col(key).isNotNull())
    steps = [seq] if isinstance(seq, str) else list(seq)
    given = [f.name for f in policy.schema if f.name in stored.columns and f.name in batch.columns]
    changes = fold(batch.select(*given, F.current_timestamp().alias("applied_at"), *[F.col(s).alias(f"_seq{k}") for k, s in enumerate(steps)]), policy, [f"_seq{k}" for k in range(len(steps))])
    others = [c for c in changes.columns if c not in policy.keys]
    changes = changes.select(*policy.keys, *[F.col(c).alias(f"_new_{c}") for c in others], F.lit(True).alias("_changed"))
    # folded first, so that a key with many rows is one row a task; then dealt out as the stored side lies already
    changes = changes.repartition(BUCKETS, *policy.keys)
    joined = stored.join(changes, list(policy.keys), "full_outer")

    def value(name: str) -> Column:
        old, new = F.col(name), F.col(f"_new_{name}")
        if name in policy.add:
            return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
        if name in policy.keep:
            return F.coalesce(new, old)
        return F.when(F.col("_changed"), new).otherwise(old)

    own = [c for c in stored.columns if c not in ("updated_at", _PART)]
    columns = [value(c).cast(stored.schema[c].dataType).alias(c) if c in others else F.col(c) for c in own]
    return joined.select(*columns, F.coalesce("_new_updated_at", "updated_at").alias("updated_at"), _part(policy).alias(_PART))


def merge(spark: SparkSession, name: str, batch: DataFrame, policy: MergePolicy, seq: str | list[str] = "seq") -> list[int]:
    """Apply a batch to the table ``name``; the parts that were rewritten.

    The batch is read twice, for the parts and for the rows. A merge that fails leaves the table as it was; one at a time."""
    keyed = prepare(batch, policy).select(*policy.keys).filter(" AND ".join(f"`{k}` IS NOT NULL" for k in policy.keys))
    parts = sorted(r.p for r in keyed.select(_part(policy).alias("p")).distinct().collect())  # at most PARTS numbers
    if not parts:
        return []
    stored = spark.table(name).filter(F.col(_PART).isin(parts))
    out = merged(stored, batch, policy, seq)
    out.select(*spark.table(name).columns).write.mode("overwrite").insertInto(name)
    return parts
