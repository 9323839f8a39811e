"""Micro-batch jobs over streams made of the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.times import day_of
from ...session import scratch_path, stream_session
from ...streaming import runs as run_stream
from ...streaming import totals as total_stream
from ...streaming import uploads as upload_stream
from .. import ledger
from .registry import query, table
from .reports import _EVENTS_SQL, run_events


@query(
    """WITH e AS (SELECT DISTINCT user_id AS r, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT printf('2024-01-%02d', k % 28 + 1) AS date, CAST(sum(k) AS BIGINT) AS domains_tracked_lifetime,
      CAST(sum(k) AS BIGINT) AS domains_tracked_24h FROM e GROUP BY 1"""
)
def stream_upload_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as upload documents with repeating ids, taken in twice; each id counts once."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    document = F.to_json(
        F.struct(
            F.format_string("2024-01-%02d", k % 28 + 1).alias("date"),
            F.struct(k.alias("domains_tracked_lifetime"), k.alias("domains_tracked_24h")).alias("global"),
            F.array().cast("array<struct<length:bigint>>").alias("length_stats"),
            F.col("user_id").cast("string").alias("run_id"),
            k.cast("string").alias("batch_id"),
        )
    )
    documents = table(spark, sf_dir, "events").select(document.alias("value"))
    home = scratch_path(spark, "uploads")
    inbox, store = f"{home}/inbox", f"{home}/ledger"
    for _ in range(2):
        documents.write.mode("append").text(inbox)
        stream = upload_stream.read_uploads(spark, inbox)
        upload_stream.apply_uploads(stream, store, f"{home}/checkpoint").awaitTermination()
    totals = upload_stream.stored_tables(ledger.read(spark, store))["global_stats"]
    return totals.drop("updated_at")


_TOTALS_SQL = """SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(sum(o_custkey) AS BIGINT) AS domains_tracked_lifetime,
      CAST(count(*) AS BIGINT) AS domains_tracked_24h FROM orders GROUP BY 1"""


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        day_of("o_orderdate").alias("date"),
        F.struct(F.col("o_custkey").alias("domains_tracked_lifetime"), F.lit(1).cast("bigint").alias("domains_tracked_24h")).alias("global"),
    )


@query(_TOTALS_SQL)
def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals per day of a stream of orders as upload documents, as of the last micro-batch."""
    home = scratch_path(spark, "totals")
    _order_documents(spark, sf_dir).repartition(3).write.parquet(f"{home}/inbox")
    schema = spark.read.parquet(f"{home}/inbox").schema
    stream = stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/inbox")
    writer = upload_stream.running_totals(stream).writeStream.outputMode("update")
    writer.foreachBatch(lambda batch, epoch: ledger.append(batch, f"{home}/totals", epoch)).option(
        "checkpointLocation", f"{home}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return ledger.latest(ledger.read(spark, f"{home}/totals"), "date")


@query(_TOTALS_SQL)
def stream_sealed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with sealed dates in a ledger: orders of three spans of time arrive in turn, a tenth of each with the span after it."""
    home = scratch_path(spark, "sealed-totals")
    documents = _order_documents(spark, sf_dir)
    late = F.when(F.col("global.domains_tracked_lifetime") % 10 == 0, 1).otherwise(0)
    span = F.when(F.col("date") < "1997-01-01", 0).when(F.col("date") < "1999-01-01", 1).otherwise(2) + late
    documents = documents.withColumn("span", span)
    schema = documents.drop("span").schema
    total_stream.create(spark, f"{home}/totals")
    for k in range(4):
        documents.filter(F.col("span") == k).drop("span").write.mode("append").parquet(f"{home}/inbox")
        stream = spark.readStream.schema(schema).parquet(f"{home}/inbox")
        total_stream.keep_totals(stream, f"{home}/totals", f"{home}/checkpoint", open_days=30).awaitTermination()
    return total_stream.totals(spark, f"{home}/totals")


@query(_EVENTS_SQL + "SELECT * FROM runs")
def stream_run_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log of a stream of events, as of its last micro-batch."""
    home = scratch_path(spark, "runs")
    inbox = f"{home}/inbox"
    run_events(table(spark, sf_dir, "events")).repartition(3).write.parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    session = run_stream.state_session(stream_session(spark))
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    run_stream.keep_runs(stream, f"{home}/log", f"{home}/checkpoint").awaitTermination()
    return run_stream.run_log(spark, f"{home}/log")
