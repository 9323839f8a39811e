"""Running totals over a total order, without a sorting task for the whole table or for one key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .stored import stored


def running(df: DataFrame, order: list[str], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None, row: str = "row", name: str = "running") -> DataFrame:
    """``df`` with the 0-based ``row`` of each row in the order of ``order`` (nulls first), and totals over all rows before it.

    ``sums`` and ``xors`` name, for each new column, the long column whose sum or exclusive or it holds. Rows are dealt
    out by ranges and sorted inside them, so a key with a third of all rows lies in many tasks; each task streams over its
    rows with the totals so far, and only one row a task passes through a window. The rows are stored in between, so
    both reads see the same split. Rows that are equal in ``order`` are told apart by where they were read; a null counts 0.
    """
    sums, xors = sums or {}, xors or {}
    names = [row, *sums, *xors]
    kept = df.columns
    sources = [None, *sums.values(), *xors.values()]
    adds = [True] * (1 + len(sums)) + [False] * len(xors)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        so_far = [np.int64(0)] * len(names)
        for batch in batches:
            columns = [pa.array(np.full(batch.num_rows, part, np.int32))]
            for k, source in enumerate(sources):
                values = np.ones(batch.num_rows, np.int64) if source is None else batch.column(source).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                through = np.cumsum(values) if adds[k] else np.bitwise_xor.accumulate(values)
                before = np.concatenate([np.zeros(1, np.int64), through[:-1]])[: batch.num_rows]
                columns.append(pa.array(before + so_far[k] if adds[k] else before ^ so_far[k]))
                if batch.num_rows:
                    so_far[k] = so_far[k] + through[-1] if adds[k] else so_far[k] ^ through[-1]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=[*kept, "_part", *[f"_at{k}" for k in range(len(names))]])

    keys = [*order, "_read"]
    # the ranges are found by reading the rows once more, so what they are made from isn't read for that
    dealt = stored(df.withColumn("_read", F.monotonically_increasing_id()), f"{name}-rows").repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    schema = StructType([*df.schema.fields, StructField("_part", IntegerType()), *[StructField(f"_at{k}", LongType()) for k in range(len(names))]])
    fixed = stored(dealt.mapInArrow(totals, schema), name)
    # what each task's rows come to: one row a task
    own = [F.count(F.lit(1)).alias("_own0")]
    own += [(F.sum if add else F.bit_xor)(F.coalesce(F.col(source), F.lit(0))).cast("long").alias(f"_own{k}") for k, (source, add) in enumerate(zip(sources, adds)) if source is not None]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = fixed.groupBy("_part").agg(*own)
    starts = starts.select("_part", *[F.coalesce((F.sum if add else F.bit_xor)(f"_own{k}").over(before), F.lit(0)).alias(f"_start{k}") for k, add in enumerate(adds)])
    placed = fixed.join(starts, "_part")
    at = [F.col(f"_start{k}") + F.col(f"_at{k}") if add else F.col(f"_start{k}").bitwiseXOR(F.col(f"_at{k}")) for k, add in enumerate(adds)]
    return placed.select(*kept, *[value.alias(n) for n, value in zip(names, at, strict=True)])
