"""Exactly-once intake of upload documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import POLICIES, fold
from ..plans import id_index, ledger
from ..plans.id_index import IDS as _IDS
from ..sources.batches import (
    PLACE,
    UPLOAD,
    parse_uploads,
    upload_global,
    upload_length_rows,
    upload_rejects,
    upload_word_rows,
)

# How documents arrived: what came first within an epoch, and so is applied first.
ARRIVAL = ["_at", "_file", "_block", "_row"]
LEDGER = f"{UPLOAD}, _at timestamp, _file string, _block bigint, _row bigint, applied_at timestamp"


def has_ids() -> Column:
    """Only documents with both ids can be recognised as replays."""
    return (F.coalesce("run_id", F.lit("")) != "") & (F.coalesce("batch_id", F.lit("")) != "")


def first_of_each_id(uploads: DataFrame, arrival: list[str]) -> DataFrame:
    """The first document to arrive per (run_id, batch_id), among those with both ids."""
    rest = [c for c in uploads.columns if c not in _IDS]
    first = uploads.filter(has_ids()).groupBy(*_IDS).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("_d"))
    return first.select(*_IDS, *[F.col(f"_d.{c}").alias(c) for c in rest])


def not_yet_applied(uploads: DataFrame, applied: DataFrame) -> DataFrame:
    """Documents whose ids are not in ``applied``; a document without ids never is.

    The ledger of ids grows without end and the micro-batch does not, so the ledger is first
    cut to the ids of this batch: that is the side a size check may broadcast, and then the
    ledger is scanned in place. The anti join that follows sees batch-sized inputs only.
    """
    asked = uploads.filter(has_ids()).select(*_IDS).distinct()
    hits = applied.select(*_IDS).join(asked, _IDS, "left_semi").distinct()
    return uploads.join(hits, _IDS, "left_anti")


def new_uploads(uploads: DataFrame, applied: DataFrame, arrival: list[str]) -> DataFrame:
    """What a batch adds: first arrivals of unseen ids, and every document without ids."""
    known = not_yet_applied(first_of_each_id(uploads, arrival), applied)
    return known.unionByName(uploads.filter(~has_ids()))


def read_uploads(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of upload documents, one JSON document per line of the files under ``path``.

    ``files_per_batch`` bounds a micro-batch when there is a backlog to take in.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_modification_time").alias("_at"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def index_path(path: str) -> str:
    """Where the ids applied to the ledger at ``path`` are indexed."""
    return f"{path}.ids"


def rejects_path(path: str) -> str:
    """Where lines that were no upload are kept, with the reason; an epoch folder each."""
    return f"{path}.rejects"


def apply_uploads(lines: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each document's first arrival to the ledger at ``path``, and what is none to its rejects.

    The ledger is the record of what was applied: ids and data are written together, under
    an epoch folder that a retry replaces. The ids are then indexed, so that a micro-batch looks up its own ids
    in a few files instead of reading all; a batch that fails in between is tried again with the same result.
    """
    spark = lines.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        arrived = batch.withColumns({"_row": F.monotonically_increasing_id(), "_line": F.col("value")})
        # Opened once per micro-batch; the plans below read the documents several times.
        judged = parse_uploads(arrived).persist()
        try:
            documents = judged.filter("valid").drop("valid", "_line")
            refused = judged.filter("NOT valid").select(*ARRIVAL, F.col("_line").alias("value"))
            asked = documents.filter(has_ids()).select(*_IDS).distinct()
            applied = id_index.lookup(asked, index_path(path), epoch)
            fresh = new_uploads(documents, applied, ARRIVAL)
            ledger.append(fresh.withColumn("applied_at", F.current_timestamp()), path, epoch)
            written = ledger.read(session, path).filter(F.col("epoch") == epoch)
            id_index.add(written.filter(has_ids()).select(*_IDS), index_path(path), epoch)
            ledger.append(upload_rejects(refused), rejects_path(path), epoch)
        finally:
            judged.unpersist()

    if not _exists(spark, path):
        ledger.create(spark, path, LEDGER)
    if not _exists(spark, index_path(path)):
        applied = ledger.read(spark, path).filter(has_ids())
        last = applied.agg(F.max("epoch")).head()[0]
        if last is not None:
            id_index.build(applied, index_path(path), last)
    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


_TABLES = {"global_stats": upload_global, "length_stats": upload_length_rows, "word_pos_stats": upload_word_rows}
# The order in which rows are applied, for tables where the last value of a column stands.
_APPLIED = {"length_stats": ["epoch", *ARRIVAL, *PLACE]}


def stored_tables(uploads: DataFrame, snapshot: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Daily totals, length and word tables of a ledger of documents (K1 to K3).

    Documents are applied as they arrived, rows as they stand in a document. With a ``snapshot`` of the same tables,
    ``uploads`` are the documents applied after it.
    """
    tables = {}
    for name, rows in _TABLES.items():
        order = _APPLIED.get(name, ["epoch"])
        if order == ["epoch"]:
            changes = rows(uploads, "epoch", "applied_at")
        else:
            changes = rows(uploads, "epoch", *ARRIVAL, "applied_at", placed=True)
        changes = changes.withColumn("epoch", F.col("epoch").cast("bigint"))
        if snapshot:
            before = snapshot[name].withColumnRenamed("updated_at", "applied_at").withColumn("epoch", F.lit(-1).cast("bigint"))
            changes = changes.unionByName(before, allowMissingColumns=True)
        tables[name] = fold(changes, POLICIES[name], order)
    return tables


def write_snapshot(spark: SparkSession, path: str, target: str, upto: int) -> None:
    """Fold the documents up to an epoch into tables under ``target``.

    Readers then open the tables and the later epochs only; the ledger stays as the record of
    applied ids, of which deduplication reads the two id columns.
    """
    applied = ledger.read(spark, path).filter(F.col("epoch") <= upto)
    for name, rows in stored_tables(applied).items():
        rows.write.mode("overwrite").parquet(f"{target}/{name}")


def tables_since(spark: SparkSession, path: str, snapshot: str, upto: int) -> dict[str, DataFrame]:
    """Current tables from a snapshot up to an epoch and the documents after it."""
    later = ledger.read(spark, path).filter(F.col("epoch") > upto)
    return stored_tables(later, {name: spark.read.parquet(f"{snapshot}/{name}") for name in _TABLES})


def reset_in_place(spark: SparkSession, path: str) -> None:
    """Empty the ledger and forget its applied ids, where they are (K14). The run log and the dimensions are elsewhere and stay.

    A stopped intake goes on with its checkpoint: only documents that arrive from then on count. Stop it first; a
    reader that has the old files open fails and has to read again.
    """
    for folder in (path, rejects_path(path)):
        id_index.clear(spark, folder)
    ledger.create(spark, path, LEDGER)
    id_index.clear(spark, index_path(path))


def reset_statistics(spark: SparkSession, path: str) -> str:
    """Start over with an empty ledger beside the old one, and return its path.

    Aggregates and applied ids live in the one ledger, so both are empty; the run log and the
    dimensions are elsewhere and stay. Point readers at the returned path.
    """
    base, _, version = path.rpartition("/v")
    fresh = f"{base}/v{int(version) + 1}" if base and version.isdigit() else f"{path}/v1"
    ledger.create(spark, fresh, LEDGER)
    return fresh


def running_totals(documents: DataFrame) -> DataFrame:
    """Totals per date of a stream of (already deduplicated) documents; use update mode, or complete."""
    return (
        upload_global(documents)
        .groupBy("date")
        .agg(
            F.sum("domains_tracked_lifetime").alias("domains_tracked_lifetime"),
            F.sum("domains_tracked_24h").alias("domains_tracked_24h"),
        )
    )
