"""Run log kept up to date from a stream of lifecycle events."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.runs import FACTS, clean_events, merge_facts, runs_of
from ..plans import ledger

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = ("seq", "ts", "event", "status", "domains_processed", "errors_count", "source", "notes")


class RunKeeper(StatefulProcessor):
    """The facts of each open run, from one micro-batch to the next.

    A run leaves the state when it finishes, or when no event of it came for ``age_ms`` of processing time: then a row says that
    it was closed, and when. State so holds open runs only. Nothing depends on it being there: a later event makes facts of its own,
    and the log merges them with the earlier ones.
    """

    def __init__(self, age_ms: int) -> None:
        self.age_ms = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "s_seq long, s_ts string, s_source string, s_notes string, c_seq long, c_done long, c_errors long, f_seq long, f_ts string, f_status string, n_seq long, n_notes string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.facts.get()
        start, counts, finish, notes = (None, None, None, None) if held is None else (tuple(held[0:4]), tuple(held[4:7]), tuple(held[7:10]), tuple(held[10:12]))
        start, counts, finish, notes = (part if part and part[0] is not None else None for part in (start, counts, finish, notes))
        for row in rows:
            if row.event == "start":
                if start is None or row.seq < start[0]:
                    start = (row.seq, row.ts, row.source, row.notes)
                continue
            if counts is None or row.seq > counts[0]:
                counts = (row.seq, row.domains_processed, row.errors_count)
            if row.event == "finish":
                if finish is None or row.seq > finish[0]:
                    finish = (row.seq, row.ts, row.status)
                if row.notes is not None and (notes is None or row.seq > notes[0]):
                    notes = (row.seq, row.notes)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if finish is not None:
            self.facts.clear()
        else:
            self.facts.update((*(start or (None,) * 4), *(counts or (None,) * 3), *(None,) * 3, *(None,) * 2))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.age_ms)
        yield Row(run_id=key[0], s=start, c=counts, f=finish, n=notes, closed_ms=None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.facts.clear()
        yield Row(run_id=key[0], s=None, c=None, f=None, n=None, closed_ms=timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


_SENT: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """The processor runs on executors: send them the package, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        package = Path(__file__).resolve().parent.parent
        path = os.path.join(tempfile.mkdtemp(prefix="zonetide-code-"), "zonetide_streaming.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(path)
        _SENT.add(context.applicationId)


def keep_runs(events: DataFrame, path: str, checkpoint: str, available_now: bool = True, idle: str = "7 days") -> StreamingQuery:
    """Append the facts of the runs each micro-batch changed to the ledger at ``path``.

    State has a row per open run; one without an event for ``idle`` is closed. Only changed runs are written, so the cost of a
    micro-batch does not grow with the log. The session must keep streaming state in RocksDB (see ``state_session``).
    """
    spark = events.sparkSession
    _ship(spark)
    age_ms = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {idle})").head()[0]
    schema = StructType.fromDDL(f"run_id string, {FACTS}, closed_ms long")
    kept = clean_events(events).select("run_id", *_EVENT).groupBy("run_id").transformWithState(RunKeeper(age_ms), schema, "Update", "ProcessingTime")
    writer = kept.writeStream.outputMode("update").foreachBatch(lambda facts, epoch: ledger.append(facts, path, epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def state_session(session: SparkSession) -> SparkSession:
    """``session`` with streaming state in RocksDB, as state with timers needs it.

    A query with timers would go on with batches without data for ever; runs are closed by the next batch that has some."""
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return session


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The run log as of the last micro-batch."""
    return runs_of(merge_facts(ledger.read(spark, path)))


def closed_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, closed_at) of runs that were closed without a finish and have had no event since."""
    last = ledger.read(spark, path).groupBy("run_id").agg(F.max("closed_ms").alias("ms"), F.max(F.when(F.col("closed_ms").isNull(), F.col("epoch"))).alias("heard"), F.max(F.when(F.col("closed_ms").isNotNull(), F.col("epoch"))).alias("shut"))
    return last.filter("shut > heard OR (shut IS NOT NULL AND heard IS NULL)").select("run_id", F.timestamp_millis("ms").alias("closed_at"))
