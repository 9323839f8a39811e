"""Monthly registrar transaction reports: CSV files with drifting headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.fixed import REPORT_COLUMN_HINTS
from ..functions.numbers import integer_or_null, report_number
from ..functions.text import report_tld, strip
from ..session import scratch_path

MEASURES = ["net_adds", "renewals", "transfers", "deletes", "domains_under_mgmt"]
SCHEMA = T.StructType(
    [
        T.StructField("report_month", T.StringType()),
        T.StructField("iana_id", T.LongType()),
        T.StructField("tld", T.StringType()),
        *[T.StructField(m, T.LongType()) for m in MEASURES],
        T.StructField("source_url", T.StringType()),
    ]
)
MONTH_IN_NAME = r"(\d{4}-\d{2})[^/]*$"
_CSV = {"header": "false", "multiLine": "true", "escape": '"', "columnPruning": "false", "columnNameOfCorruptRecord": "_raw"}


def header_positions(cells: Column) -> dict[str, Column]:
    """Field -> 0-based position of the first header cell that holds one of the field's hints, null if there is none."""
    cleaned = F.transform(cells, lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))

    def position(hints: tuple[str, ...]) -> Column:
        hit = F.transform(cleaned, lambda c: F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(c, h)))
        return F.nullif(F.array_position(hit, True), F.lit(0)) - 1

    return {field: position(tuple(hints)) for field, hints in REPORT_COLUMN_HINTS.items()}


def cell_count(record: Column) -> Column:
    """Cells of a CSV record as it stands in the file: commas outside of quotes, and one more."""
    bare = F.regexp_replace(record, '"[^"]*"', "")  # a doubled quote is two quoted runs side by side
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _records(spark: SparkSession, path: str | list[str], width: int, months: list[str] | None, month_pattern: str) -> DataFrame:
    """(file, at, n_cells, cells) of every record; at most ``width`` cells are taken apart, quoted line breaks are part of a cell."""
    names = [f"c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_raw"]])
    read = spark.read.schema(schema).options(**_CSV).csv(path)
    file = F.col("_metadata.file_path")
    if months is not None:
        # a condition on the file's name: files of other months aren't opened
        read = read.filter(F.regexp_extract(file, month_pattern, 1).isin(months))
    # a record with another number of cells comes with its text
    n_cells = F.when(F.col("_raw").isNull(), F.lit(width)).otherwise(cell_count(F.col("_raw")))
    return read.select(file.alias("file"), F.monotonically_increasing_id().alias("at"), n_cells.alias("n_cells"), F.array(*names).alias("cells"), "_raw")


def _headers(spark: SparkSession, path: str | list[str], months: list[str] | None, month_pattern: str) -> DataFrame:
    """(file, header, n_header) from the first record of each file: its text, if it has more than one cell."""
    records = _records(spark, path, 1, months, month_pattern)
    first = records.groupBy("file").agg(F.min_by(F.struct("_raw", "cells", "n_cells"), "at").alias("r"))
    text = F.coalesce("r._raw", F.get("r.cells", F.lit(0)), F.lit(""))
    return first.select("file", text.alias("header"), F.col("r.n_cells").alias("n_header"))


def read_registrar_reports(
    spark: SparkSession,
    path: str | list[str],
    months: list[str] | None = None,
    month_pattern: str = MONTH_IN_NAME,
) -> DataFrame:
    """Rows of all report files under ``path``; the month comes from the file name.

    All files are read by one scan, cells by position; what a position means comes from the first record of
    the row's file, which a scan before finds. So there are as many jobs for a thousand files as for one. A record is kept
    if it has at least as many cells as its header. Files without an IANA id and a TLD column give no rows.
    """
    home = scratch_path(spark, "report-headers")
    _headers(spark, path, months, month_pattern).write.parquet(home)
    headers = spark.read.parquet(home)
    width = headers.agg(F.max("n_header")).head()[0]
    if width is None:
        return spark.createDataFrame([], SCHEMA)
    cells = F.from_csv("header", ", ".join(f"c{i} string" for i in range(width)), {"escape": '"', "multiLine": "true"})
    parsed = headers.withColumn("h", cells)
    at = header_positions(F.array(*[F.col(f"h.c{i}") for i in range(width)]))
    wanted = ["iana_id", "tld", *MEASURES]
    shapes = parsed.select(F.col("file").alias("of"), "n_header", *[at[f].cast("int").alias(f"at_{f}") for f in wanted])
    shapes = shapes.filter("at_iana_id IS NOT NULL AND at_tld IS NOT NULL")
    rows = _records(spark, path, width, months, month_pattern).join(shapes, F.col("file") == F.col("of")).filter("n_cells >= n_header")
    cell = {f: F.get("cells", F.col(f"at_{f}")) for f in wanted}
    return rows.select(
        F.regexp_extract("file", month_pattern, 1).alias("report_month"),
        integer_or_null(cell["iana_id"]).alias("iana_id"),
        report_tld(cell["tld"]).alias("tld"),
        *[report_number(cell[m]).alias(m) for m in MEASURES],
        F.col("file").alias("source_url"),
    ).filter(F.col("iana_id").isNotNull() & (F.col("tld") != ""))
