"""One large JSON or HTML document read by all cores.

A document is one line as often as not, so it is not split at lines but at a character that ends many of its parts: Spark's text source
takes any separator, deals out byte ranges and resynchronises each at the next separator. What a piece means depends on what stands before
it: whether it starts inside a string, how deep, inside which table. Each is a sum or a last value over the pieces before, so a block
(one byte range) is summed up by itself, the sums of a file's blocks are accumulated, which is one row a byte range, and every piece then
has its state. Nothing is read whole by one task; a single member or link of a document has to fit into one.

Documents are taken as well-formed: a JSON document is an object, and an HTML link has an opening tag of its own. Files of other
contents give other results than the readers of whole documents in ``companies``, which refuse them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from ..functions.fixed import INDEX_TABLE_PATTERN, TICKER_LINK_PATTERN
from ..session import scratch_path
from . import companies

_BLOCK = ["file", "block"]


def _in_block() -> WindowSpec:
    return Window.partitionBy(*_BLOCK).orderBy("row")


def _before() -> WindowSpec:
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, row, piece): the text between separators, in order of ``row`` inside a byte range."""
    return spark.read.text(path, lineSep=separator).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("piece"),
    )


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _depth(parts: Column, side: int) -> Column:
    """How much deeper a piece ends than it starts, if every second of its parts, from ``side`` on, is outside of strings."""
    outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == side), "")
    return F.length(F.regexp_replace(outside, r"[^{\[]", "")) - F.length(F.regexp_replace(outside, r"[^}\]]", ""))


def json_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, key, value): the members of the JSON object in each file, in order; ``value`` is JSON text."""
    pieces = _pieces(spark, path, ",")
    parts = F.split(F.regexp_replace("piece", r"\\.", ""), '"')
    pieces = pieces.withColumns({"quotes": F.size(parts) - 1, "deeper0": _depth(parts, 0), "deeper1": _depth(parts, 1)})
    # inside a block, for a block that starts outside of a string (0) and for one that starts inside (1)
    pieces = pieces.withColumn("odd", F.sum("quotes").over(_in_block()) % 2)
    begins_odd = (F.col("odd") + F.col("quotes")) % 2 == 1
    for start in (0, 1):
        here, other = f"deeper{start}", f"deeper{1 - start}"
        pieces = pieces.withColumn(f"depth{start}", F.sum(F.when(begins_odd, F.col(other)).otherwise(F.col(here))).over(_in_block()))
    pieces = _stored(pieces.select(*_BLOCK, "row", "piece", "odd", "depth0", "depth1"), "json-pieces")

    blocks = pieces.groupBy(*_BLOCK).agg(*[F.max_by(c, "row").alias(c) for c in ("odd", "depth0", "depth1")])
    zero = F.lit(0)
    blocks = blocks.withColumn("start_odd", F.coalesce(F.sum("odd").over(_before()) % 2, zero))
    gained = F.when(F.col("start_odd") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    blocks = blocks.withColumn("gained", gained).withColumn("start_depth", F.coalesce(F.sum("gained").over(_before()), zero))
    placed = pieces.join(blocks.select(*_BLOCK, "start_odd", "start_depth"), _BLOCK)
    depth = F.col("start_depth") + F.when(F.col("start_odd") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    # the comma after a piece parts two members if it stands outside of strings and inside of the outermost object alone
    parting = ((F.col("odd") + F.col("start_odd")) % 2 == 0) & (depth == 1)
    placed = placed.select(*_BLOCK, "row", "piece", parting.cast("int").alias("parting"))
    placed = _stored(placed.withColumn("member", F.sum("parting").over(_in_block()) - F.col("parting")), "json-members")

    counts = placed.groupBy(*_BLOCK).agg(F.sum("parting").alias("n"))
    ends = F.sum("n").over(Window.partitionBy("file"))  # as all of these: over the blocks of a file, not its pieces
    counts = counts.select(*_BLOCK, F.coalesce(F.sum("n").over(_before()), zero).alias("members_before"), ends.alias("last"))
    numbered = placed.join(counts, _BLOCK).withColumn("pos", F.col("members_before") + F.col("member"))
    pieces_of = F.array_sort(F.collect_list(F.struct("block", "row", "piece")))
    text = F.array_join(F.transform(pieces_of, lambda p: p["piece"]), ",")
    members = numbered.groupBy("file", "pos").agg(text.alias("text"), F.first("last").alias("last"))
    inner = F.when(F.col("pos") == 0, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
    inner = F.when(F.col("pos") == F.col("last"), F.regexp_replace(inner, r"\}\s*$", "")).otherwise(inner)
    one = F.from_json(F.concat(F.lit("{"), inner, F.lit("}")), "map<string,string>")
    return members.select("file", "pos", F.explode(one).alias("key", "value"))


def ticker_rows(spark: SparkSession, path: str) -> DataFrame:
    """Company entries of ticker documents, as ``companies.ticker_rows`` has them; ``pos`` counts the members of a file."""
    return companies.ticker_entries(json_members(spark, path).withColumnRenamed("value", "entry"))


def domain_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(key, domain) of flat JSON objects, both lower-cased; the last of equal keys stands, in the order of file names."""
    members = json_members(spark, path)
    return members.groupBy(F.lower("key").alias("key")).agg(F.lower(F.max_by("value", F.struct("file", "pos"))).alias("domain"))


_OPEN = INDEX_TABLE_PATTERN.partition("(")[0]
_CLOSE = INDEX_TABLE_PATTERN.rpartition(")")[2]
_LINK_END = TICKER_LINK_PATTERN.rpartition(")")[2]


def index_tickers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct tickers linked inside the constituent tables of index pages, however long a table is."""
    pieces = _pieces(spark, path, _LINK_END).withColumn("piece", F.concat("piece", F.lit(_LINK_END)))
    # what the last tag of a table in a piece does: after an opening one its text is inside, after a closing one outside
    after_close = F.substring_index("piece", _CLOSE, -1)
    opens = after_close.rlike(_OPEN)
    closes = F.col("piece").contains(_CLOSE)
    inside = F.when(opens, True).when(closes, False)
    own = F.when(opens, F.regexp_replace(after_close, f"(?s)^.*?{_OPEN}", "")).otherwise(after_close)
    ticker = F.regexp_extract(own, TICKER_LINK_PATTERN, 1)
    pieces = pieces.select(*_BLOCK, "row", inside.alias("inside"), closes.alias("closes"), F.nullif(ticker, F.lit("")).alias("ticker"))
    # only tags of tables and tickers are kept from here on
    marks = _stored(pieces.filter("inside IS NOT NULL OR ticker IS NOT NULL"), "html-marks")
    blocks = marks.groupBy(*_BLOCK).agg(F.max_by("inside", F.when(F.col("inside").isNotNull(), F.col("row"))).alias("ends"))
    blocks = blocks.select(*_BLOCK, F.coalesce(F.last("ends", ignorenulls=True).over(_before()), F.lit(False)).alias("starts"))
    shut = marks.filter("closes").groupBy("file").agg(F.max(F.struct("block", "row")).alias("last_close"))
    placed = marks.withColumn("here", F.last("inside", ignorenulls=True).over(_in_block())).join(blocks, _BLOCK).join(shut, "file")
    # a table that is never closed is none
    found = F.coalesce("here", "starts") & (F.struct("block", "row") < F.col("last_close"))
    return placed.filter(found & F.col("ticker").isNotNull()).select("ticker").distinct()
