"""JSON batches posted by collectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import number_or_zero
from ..functions.text import or_default
from ..operators.upsert import POLICIES

_UPLOAD_ROW = "length bigint, {extra} tracked_count bigint, unregistered_found bigint, unused_found bigint"
UPLOAD = (
    "date string, "
    "global struct<domains_tracked_lifetime bigint, domains_tracked_24h bigint>, "
    f"length_stats array<struct<tld string, {_UPLOAD_ROW.format(extra='total_possible bigint,')}>>, "
    f"length_stats_by_tld array<struct<tld string, {_UPLOAD_ROW.format(extra='total_possible bigint,')}>>, "
    f"word_pos_stats array<struct<tld string, pos string, {_UPLOAD_ROW.format(extra='')}>>, "
    "run_id string, batch_id string"
)


def parse_uploads(lines: DataFrame, column: str = "value") -> DataFrame:
    """Upload documents with a ``valid`` flag: date, global and a length_stats array present."""
    others = [c for c in lines.columns if c != column]
    docs = lines.select(*others, F.from_json(F.col(column), UPLOAD).alias("d")).select(*others, "d.*")
    present = (
        (F.coalesce(F.col("date"), F.lit("")) != "")
        & F.col("global").isNotNull()
        & F.col("length_stats").isNotNull()
    )
    return docs.withColumn("valid", present)


def upload_global(uploads: DataFrame, *carry: str) -> DataFrame:
    """One row per upload for the daily totals."""
    return uploads.select(
        *carry,
        "date",
        number_or_zero("global.domains_tracked_lifetime").alias("domains_tracked_lifetime"),
        number_or_zero("global.domains_tracked_24h").alias("domains_tracked_24h"),
    )


def upload_rejects(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are no upload: the text as it came, and what it lacks."""
    others = [c for c in lines.columns if c != column]
    document = F.try_parse_json(F.col(column))
    d = F.from_json(F.col(column), UPLOAD)
    reason = (
        F.when(document.isNull(), "not JSON")
        .when(~F.schema_of_variant(document).startswith("OBJECT"), "not an object")
        .when(F.coalesce(d["date"], F.lit("")) == "", "no date")
        .when(d["global"].isNull(), "no global totals")
        .when(d["length_stats"].isNull(), "no list of length_stats")
    )
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    return lines.select(*others, column, F.when(~blank, reason).alias("reason")).filter(F.col("reason").isNotNull())


# Where a row stood in its document, for rows whose order counts.
PLACE = ["_array", "_pos"]


def _rows(uploads: DataFrame, array: str, carry: tuple[str, ...], number: int = 0) -> DataFrame:
    exploded = uploads.select(*carry, F.lit(number).alias("_array"), F.posexplode(array).alias("_pos", "r"))
    return exploded.filter(F.col("r").isNotNull()).select(*carry, *PLACE, "r.*")


def _counters(*names: str) -> list[Column]:
    return [number_or_zero(n).alias(n) for n in names]


def upload_length_rows(uploads: DataFrame, *carry: str, placed: bool = False) -> DataFrame:
    """Length rows of both arrays under the fixed ``overall`` snapshot.

    No TLD means ``ALL`` in the first array; rows without a key are no rows of the table. ``placed`` rows also have
    the columns ``PLACE``: the arrays are applied one after the other, each in its order.
    """
    totals = _rows(uploads, "length_stats", carry).withColumn("tld", or_default("tld", "ALL"))
    both = totals.unionByName(_rows(uploads, "length_stats_by_tld", carry, 1))
    return both.filter(F.col("tld").isNotNull() & F.col("length").isNotNull()).select(
        *carry,
        *(PLACE if placed else []),
        F.lit("overall").alias("snap_date"),
        "tld",
        "length",
        "total_possible",
        *_counters("tracked_count", "unregistered_found", "unused_found"),
    )


def upload_word_rows(uploads: DataFrame, *carry: str) -> DataFrame:
    rows = _rows(uploads, "word_pos_stats", carry)
    return rows.filter(F.col("pos").isNotNull() & F.col("length").isNotNull()).select(
        *carry,
        F.lit("overall").alias("snap_date"),
        or_default("tld", "ALL").alias("tld"),
        "pos",
        "length",
        *_counters("tracked_count", "unregistered_found", "unused_found"),
    )


# ---- {rows: [...]} documents -------------------------------------------------


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("r", path, "variant"))


def _truthy(path: str) -> Column:
    """Loose truth of a JSON value: false, 0, empty text, null and missing are false."""
    kind = _kind(path)
    return (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get("r", path, "boolean"))
        .when(kind == "STRING", F.try_variant_get("r", path, "string") != "")
        .when(kind.rlike("^(OBJECT|ARRAY)"), F.lit(True))
        .otherwise(F.try_variant_get("r", path, "double") != 0)
    )


def _value(field: T.StructField) -> Column:
    path = f"$.{field.name}"
    if isinstance(field.dataType, T.BooleanType):
        kind = _kind(path)
        return F.when(kind.isNotNull() & (kind != "VOID"), _truthy(path))
    value = F.try_variant_get("r", path, field.dataType.simpleString())
    if isinstance(field.dataType, T.LongType):
        # A number written as a text with decimals is still that number.
        return F.coalesce(value, F.try_variant_get("r", path, "double").try_cast("bigint"))
    return value


def row_batches(documents: DataFrame, table: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of ``{rows: [...]}`` documents for one stored table.

    Rows need their text keys as texts and their number keys as numbers; null rows, and rows
    with a missing or blank key, go to the rejects. ``seq`` keeps the order inside a document. A document that is no JSON
    or has no list of rows is a reject as a whole, with its text and no ``seq``.
    """
    policy = POLICIES[table]
    others = [c for c in documents.columns if c != column]
    # a list that isn't there, or is none, makes the whole document a reject
    asked = documents.withColumn("_rows", F.try_variant_get(F.try_parse_json(F.col(column)), "$.rows", "array<variant>"))
    exploded = asked.filter(F.col("_rows").isNotNull()).select(*others, F.posexplode("_rows").alias("seq", "r"))
    good = F.lit(True)
    for name in policy.text_keys:
        good = good & (_kind(f"$.{name}") == "STRING")
    for name in policy.number_keys:
        number = F.try_variant_get("r", f"$.{name}", "double")
        text = F.try_variant_get("r", f"$.{name}", "string")
        good = good & number.isNotNull() & ~F.isnan(number) & (F.trim(text) != "")
    judged = exploded.withColumn("_good", F.coalesce(good, F.lit(False)))
    rows = judged.filter("_good").select(*others, "seq", *[_value(f).alias(f.name) for f in policy.schema])
    rejects = judged.filter("not _good").select(*others, "seq", F.to_json("r").alias("row"))
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    whole = asked.filter(F.col("_rows").isNull() & ~blank).select(*others, F.lit(None).cast("int").alias("seq"), F.col(column).alias("row"))
    return rows, rejects.unionByName(whole)
