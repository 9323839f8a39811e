"""Running totals per date: open dates are the state, sealed dates a ledger that late rows add to.

A date is open while it is at most so many days before the newest one seen; older ones are sealed. A micro-batch adds its sums to
the open dates, carried from the micro-batch before, and appends what has been sealed since to the ledger. Rows of a sealed date are
appended there as another part of its sum: they are never dropped, and no sealed date comes back into the state. So is a date
that can't be read as one.

Under a path: ``open/epoch=<n>`` has the open dates after micro-batch n, kept for the last two; ``sealed/epoch=<n>`` what it sealed;
``folded/epoch=<n>`` the sealed sums of all micro-batches up to n, one row a date. A micro-batch that is tried again
reads what the one before it left and writes the same again.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import id_index, ledger
from .uploads import running_totals

OPEN_DAYS = 3
FOLD_EVERY = 32
# Stands for the newest date while none that can be read has been seen.
_NONE_SEEN = date(1900, 1, 1)
_SUMS = ["domains_tracked_lifetime", "domains_tracked_24h"]
_SCHEMA = "date string, domains_tracked_lifetime bigint, domains_tracked_24h bigint"


def _day() -> Column:
    return F.try_to_date("date", "yyyy-MM-dd")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _read(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.schema(f"{_SCHEMA}, newest date, epoch int").parquet(f"{path}/{part}")


def create(spark: SparkSession, path: str) -> None:
    """An empty store; the folders of epoch -1 carry the schema."""
    for part in ("open", "sealed", "folded"):
        ledger.create(spark, f"{path}/{part}", f"{_SCHEMA}, newest date")


def apply_batch(batch: DataFrame, path: str, epoch: int, open_days: int = OPEN_DAYS, fold_every: int = FOLD_EVERY) -> None:
    """Add the documents of micro-batch ``epoch`` to the store."""
    spark = batch.sparkSession
    before = _read(spark, path, "open").filter(F.col("epoch") == epoch - 1)
    known = before.agg(F.max("newest")).head()[0]
    rows = before.filter("newest IS NULL").select("date", *_SUMS).unionByName(running_totals(batch).select("date", *_SUMS))
    sums = _summed(rows).persist()  # a row a date of the batch or the state
    try:
        newest = max(d or _NONE_SEEN for d in (known, sums.agg(F.max(_day())).head()[0]))
        is_open = F.coalesce(_day() >= F.lit(newest - timedelta(days=open_days)), F.lit(False))
        done = sums.filter(~is_open).withColumn("newest", F.lit(None).cast("date"))
        if not done.isEmpty():
            ledger.append(done, f"{path}/sealed", epoch)
        if epoch and epoch % fold_every == 0:
            fold(spark, path, epoch - 1)
        # last and in one file: a reader takes the newest micro-batch that has left its open dates
        mark = spark.range(1).select(F.lit(newest).alias("newest"))
        ledger.append(sums.filter(is_open).unionByName(mark, allowMissingColumns=True).coalesce(1), f"{path}/open", epoch)
        id_index.clear(spark, f"{path}/open/epoch={epoch - 2}")
    finally:
        sums.unpersist()


def _sealed(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """Parts of the sums of sealed dates up to a micro-batch; what has been folded is not read again."""
    folds = _read(spark, path, "folded").filter(F.col("epoch") < upto)
    last = folds.agg(F.max("epoch")).head()[0]
    later = _read(spark, path, "sealed").filter(F.col("epoch") <= upto)
    if last is None:
        return later.select("date", *_SUMS)
    return later.filter(F.col("epoch") > last).unionByName(folds.filter(F.col("epoch") == last)).select("date", *_SUMS)


def fold(spark: SparkSession, path: str, upto: int) -> None:
    """Sum the sealed parts up to a micro-batch, so that reads stay short; the parts stay as the record."""
    folded = _summed(_sealed(spark, path, upto)).withColumn("newest", F.lit(None).cast("date"))
    ledger.append(folded, f"{path}/folded", upto)


def keep_totals(documents: DataFrame, path: str, checkpoint: str, open_days: int = OPEN_DAYS, available_now: bool = True) -> StreamingQuery:
    """Keep the totals of a stream of (already deduplicated) documents in the store at ``path``, which ``create`` has made."""
    writer = documents.writeStream.foreachBatch(lambda batch, epoch: apply_batch(batch, path, epoch, open_days))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def open_dates(spark: SparkSession, path: str) -> DataFrame:
    """The open dates and their sums so far."""
    rows = _read(spark, path, "open")
    return rows.filter((F.col("epoch") == _last(spark, path)) & F.col("newest").isNull()).select("date", *_SUMS)


def _last(spark: SparkSession, path: str) -> int:
    last = _read(spark, path, "open").agg(F.max("epoch")).head()[0]
    return -1 if last is None else last


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals per date as of the last micro-batch."""
    return _summed(_sealed(spark, path, _last(spark, path)).unionByName(open_dates(spark, path)))
