"""Sources, sinks and read products that no other query goes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ...functions.times import day_of
from ...operators.upsert import POLICIES, prepare
from ...session import scratch_path
from ...sources import batches, companies, large_documents, lists
from ...sources.registrar_reports import read_registrar_reports
from ...streaming import uploads
from .. import ledger, reports
from .dimensions import _MONTHLY_SQL, monthly
from .documents import INDEX_TICKERS_SQL, index_pages
from .registry import query, table
from .reports import _EVENTS_SQL, _LAST_SQL, _length_table, _word_table, global_stats, run_log
from .words import _TOKENS_SQL, words

_STORED_SQL = """, ls AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'ALL' ELSE lower(l_returnflag) END AS tld, CAST(l_linenumber AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS tracked,
      CAST(count(*) FILTER (l_quantity > 25) AS BIGINT) AS unregistered_found, CAST(count(*) FILTER (l_quantity > 40) AS BIGINT) AS unused_found
    FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)"""


@query(
    _EVENTS_SQL
    + _STORED_SQL
    + f""", last AS ({_LAST_SQL}),
    d AS (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 1)
    SELECT 'totals' AS part, CAST(NULL AS VARCHAR) AS tld, CAST(NULL AS VARCHAR) AS pos, CAST(NULL AS BIGINT) AS length, CAST(NULL AS BIGINT) AS total_possible,
      (SELECT CAST(sum(user_id) AS BIGINT) FROM events) AS tracked, CAST(d.n AS BIGINT) AS unregistered_found, CAST(NULL AS BIGINT) AS unused_found, d.at AS last_updated_at, last.status AS last_run_status FROM d, last
    UNION ALL SELECT 'lengths', NULL, NULL, length, 36, tracked, unregistered_found, unused_found, NULL, NULL FROM ls WHERE tld = 'ALL'
    UNION ALL SELECT 'tld lengths', tld, NULL, length, 36, tracked, unregistered_found, unused_found, NULL, NULL FROM ls WHERE tld <> 'ALL'
    UNION ALL SELECT 'words', NULL, 'noun', length, NULL, tracked, unregistered_found, unused_found, NULL, NULL FROM ls WHERE tld = 'ALL'
    UNION ALL SELECT 'totals of nothing', NULL, NULL, NULL, NULL, 0, 0, NULL, NULL, last.status FROM last"""
)
def overview_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of the overview below each other; then those while no day has been counted, of which only the totals have a row."""
    totals = global_stats(spark, sf_dir)
    args = (_length_table(spark, sf_dir), _word_table(spark, sf_dir), run_log(spark, sf_dir))
    out = None
    for suffix, found in (("", reports.overview(totals, *args)), (" of nothing", reports.overview(totals.filter(F.lit(False)), *args))):
        head = found.totals.select(F.col("domains_tracked_lifetime").alias("tracked"), F.col("domains_tracked_24h").alias("unregistered_found"), "last_updated_at", "last_run_status")
        for part, rows in (("totals", head), ("lengths", found.lengths), ("tld lengths", found.tld_lengths), ("words", found.words)):
            rows = rows.withColumn("part", F.lit(part + suffix))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    columns = ("part", "tld", "pos", "length", "total_possible", "tracked", "unregistered_found", "unused_found", "last_updated_at", "last_run_status")
    return out.withColumn("last_updated_at", F.substring(F.col("last_updated_at").cast("string"), 1, 19)).select(*columns)


@query("SELECT 'key-' || c_custkey AS key, 'www.c' || c_custkey || '.com' AS domain FROM customer")
def override_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as one JSON object of overrides, keys and domains in mixed case."""
    number = F.col("c_custkey").cast("string")
    entry = F.struct(F.concat(F.lit("KEY-"), number), F.concat(F.lit("WWW.C"), number, F.lit(".Com")))
    documents = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return companies.domain_overrides(documents)


def _customer_documents(spark: SparkSession, sf_dir: str, member: Column) -> str:
    """A file a nation, each one JSON object of its customers in the order of their keys; the folder of the files."""
    path = scratch_path(spark, "customer-documents")
    customers = table(spark, sf_dir, "customer")
    nations = customers.select("c_nationkey").distinct()
    lines = customers.select("c_nationkey", F.lit(1).alias("at"), "c_custkey", F.concat(member, F.lit(",")).alias("value"))
    for at, text in ((0, "{"), (2, '"end": null}')):
        lines = lines.unionByName(nations.select("c_nationkey", F.lit(at).alias("at"), F.lit(text).alias("value")), allowMissingColumns=True)
    files = lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "at", "c_custkey")
    files.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    return path


@query(
    """SELECT CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS pos, 'T,' || c_custkey AS ticker, 'a "},{' || c_name AS name, CAST(c_custkey AS VARCHAR) AS cik
    FROM customer QUALIFY c_custkey % 7 <> 0"""
)
def ticker_document_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as one long ticker document, read by byte ranges; some entries are no objects."""
    number = F.col("c_custkey").cast("string")
    entry = F.to_json(F.struct(number.alias("cik_str"), F.concat(F.lit("T,"), number).alias("ticker"), F.concat(F.lit('a "},{'), "c_name").alias("title")))
    member = F.concat(F.lit('"'), number, F.lit('": '), F.when(F.col("c_custkey") % 7 == 0, "[1, {}]").otherwise(entry))
    return large_documents.ticker_rows(spark, _customer_documents(spark, sf_dir, member))


@query(
    """SELECT 'key-' || c_custkey % 1000 AS key, arg_max('www,c' || c_custkey || '.com', (CAST(c_nationkey AS VARCHAR) || '/', c_custkey)) AS domain FROM customer GROUP BY 1
    UNION ALL SELECT 'end', NULL"""
)
def override_document_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as one long document of overrides; the last of equal keys stands."""
    number = F.col("c_custkey").cast("string")
    member = F.concat(F.lit('"KEY-'), (F.col("c_custkey") % 1000).cast("string"), F.lit('":"WWW,C'), number, F.lit('.Com"'))
    return large_documents.domain_overrides(spark, _customer_documents(spark, sf_dir, member))


@query(INDEX_TICKERS_SQL)
def index_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below each other as long index pages, read by byte ranges."""
    path = scratch_path(spark, "index-pages")
    index_pages(spark, sf_dir).write.text(path)
    return large_documents.index_tickers(spark, path)


@query("SELECT o_orderpriority || ' ' || o_orderkey AS word FROM orders WHERE o_orderkey % 5 <> 0")
def word_list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a word file, with white space around them; some lines are blank."""
    word = F.concat(F.lit("\t "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("  "))
    lines = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, " \t").otherwise(word).alias("value"))
    return lists.word_list(lines)


@query("SELECT 'd' || o_custkey || '.com' AS domain, '1996-01' AS snap_month, o_orderkey AS rank FROM orders WHERE o_orderkey <= 5000 AND o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0")
def site_ranks_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ranked sites up to a rank; ranks that are no number and blank sites are left out."""
    key = F.col("o_orderkey").cast("string")
    rank = F.when(F.col("o_orderkey") % 10 == 0, F.concat(key, F.lit("th"))).otherwise(F.concat(F.lit(" "), key))
    domain = F.when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.concat(F.lit("https://WWW.D"), F.col("o_custkey").cast("string"), F.lit(".com/x")))
    sites = table(spark, sf_dir, "orders").select(rank.alias("rank"), domain.alias("domain"))
    return companies.site_ranks(sites, "1996-01", 5000)


@query(
    """SELECT 'd' || o_orderkey AS domain, [1, 0, 1, 0, NULL, NULL, 1][CAST(o_orderkey % 7 AS INTEGER) + 1] AS has_mx, [1, 0, 1, 0, NULL, NULL, 1][CAST(o_custkey % 7 AS INTEGER) + 1] AS dnssec,
      'ok' AS probe_status FROM orders"""
)
def tri_state_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose truth of JSON values: yes and no in several spellings, null and missing stay unknown."""

    def value(name: str, key: str):
        spelled = F.array(*[F.lit(v) for v in ("true", "false", "1", '""', "null", "", '"no"')])
        one = F.get(spelled, (F.col(key) % 7).cast("int"))
        return F.when(one == "", "").otherwise(F.concat(F.lit(f', "{name}": '), one))

    row = F.concat(F.lit('{"rows": [{"snap_month": "1996-01", "domain": "D'), F.col("o_orderkey").cast("string"), F.lit('"'), value("has_mx", "o_orderkey"), value("dnssec", "o_custkey"), F.lit("}]}"))
    rows, _ = batches.row_batches(table(spark, sf_dir, "orders").select(row.alias("value")), "monthly_probe")
    return prepare(rows, POLICIES["monthly_probe"]).select("domain", F.col("has_mx").cast("int").alias("has_mx"), F.col("dnssec").cast("int").alias("dnssec"), "probe_status")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN '{"rows": "none"}' WHEN o_orderkey % 3 = 1 THEN 'not json ' || o_orderkey ELSE '{"id":' || o_orderkey || '}' END AS "row", CASE WHEN o_orderkey % 3 = 2 THEN 1 END AS seq FROM orders"""
)
def rejected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a list of rows are rejects as a whole, rows without their key by themselves."""
    key = F.col("o_orderkey").cast("string")
    good = F.concat(F.lit('{"rows": [{"tld": "a", "type": "b"}, {"id":'), key, F.lit("}]}"))
    text = F.when(F.col("o_orderkey") % 3 == 0, '{"rows": "none"}').when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("not json "), key)).otherwise(good)
    _, rejects = batches.row_batches(table(spark, sf_dir, "orders").select(key.alias("id"), text.alias("value")), "tld_dim")
    return rejects.select("id", "row", "seq")


@query(_TOKENS_SQL + "SELECT row_number() OVER (ORDER BY word) - 1 AS line, word FROM (SELECT DISTINCT word FROM w)")
def word_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all words, written as sorted lines and read back with their numbers."""
    path = scratch_path(spark, "words")
    ledger.export_words(words(spark, sf_dir).select("word").distinct(), path)
    # files and lines are in order; a line's number is how many lines come before it
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("word"))
    sizes = {r.file: r["count"] for r in lines.groupBy("file").count().collect()}  # one row a file
    starts, before = [], 0
    for file in sorted(sizes):
        starts.append((file, before))
        before += sizes[file]
    first = lines.groupBy("file").agg(F.min("at").alias("first"))
    placed = lines.join(first, "file").join(spark.createDataFrame(starts, "file string, start long"), "file")
    return placed.select((F.col("start") + F.col("at") - F.col("first")).alias("line"), "word")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as upload documents, two length rows and a word row each; (order, document)."""
    key, status = F.col("o_orderkey"), F.lower("o_orderstatus")
    counts = [F.lit(1).alias("tracked_count"), (key % 2).alias("unregistered_found"), (key % 3).alias("unused_found")]
    lengths = F.array(F.struct((key % 5).alias("length"), key.alias("total_possible"), *counts))
    tlds = F.array(F.struct(status.alias("tld"), (key % 5).alias("length"), F.col("o_custkey").alias("total_possible"), *counts))
    said = F.array(F.struct(F.col("o_orderpriority").alias("pos"), (key % 5).alias("length"), *counts))
    total = F.struct(F.lit(1).alias("domains_tracked_lifetime"), (key % 2).alias("domains_tracked_24h"))
    document = F.struct(
        day_of("o_orderdate").alias("date"), total.alias("global"), lengths.alias("length_stats"), tlds.alias("length_stats_by_tld"), said.alias("word_pos_stats"),
        F.col("o_custkey").cast("string").alias("run_id"), key.cast("string").alias("batch_id"),
    )
    return table(spark, sf_dir, "orders").select(key.alias("order"), F.to_json(document).alias("value"))


_UPLOADED_SQL = """SELECT 'length' AS kind, tld, CAST(NULL AS VARCHAR) AS pos, length, sum(tracked) AS tracked_count, sum(unregistered) AS unregistered_found, sum(unused) AS unused_found, max(total) AS total_possible FROM (
      SELECT unnest(['ALL', lower(o_orderstatus)]) AS tld, o_orderkey % 5 AS length, 1::BIGINT AS tracked, (o_orderkey % 2)::BIGINT AS unregistered, (o_orderkey % 3)::BIGINT AS unused, NULL::BIGINT AS total FROM orders {where}) GROUP BY tld, length
    UNION ALL SELECT 'word', 'ALL', o_orderpriority, o_orderkey % 5, count(*), CAST(sum(o_orderkey % 2) AS BIGINT), CAST(sum(o_orderkey % 3) AS BIGINT), NULL FROM orders {where} GROUP BY 3, 4"""


def _tables(stored: dict[str, DataFrame]) -> DataFrame:
    kinds = (("length", stored["length_stats"].drop("total_possible")), ("word", stored["word_pos_stats"]))
    out = kinds[0][1].withColumn("kind", F.lit("length")).unionByName(kinds[1][1].withColumn("kind", F.lit("word")), allowMissingColumns=True)
    return out.select("kind", "tld", "pos", "length", "tracked_count", "unregistered_found", "unused_found", F.lit(None).cast("bigint").alias("total_possible"))


@query(f"SELECT * REPLACE (CAST(tracked_count AS BIGINT) AS tracked_count, CAST(unregistered_found AS BIGINT) AS unregistered_found, CAST(unused_found AS BIGINT) AS unused_found) FROM ({_UPLOADED_SQL.format(where='')})")
def stream_upload_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and word tables of orders taken in as uploads, the first half of them twice."""
    home = scratch_path(spark, "uploads")
    documents = _documents(spark, sf_dir)
    for part in (F.col("order") % 2 == 0, F.lit(True)):
        documents.filter(part).select("value").write.mode("append").text(f"{home}/inbox")
        uploads.apply_uploads(uploads.read_uploads(spark, f"{home}/inbox"), f"{home}/ledger", f"{home}/checkpoint").awaitTermination()
    return _tables(uploads.stored_tables(ledger.read(spark, f"{home}/ledger")))


@query(f"SELECT * REPLACE (CAST(tracked_count AS BIGINT) AS tracked_count, CAST(unregistered_found AS BIGINT) AS unregistered_found, CAST(unused_found AS BIGINT) AS unused_found) FROM ({_UPLOADED_SQL.format(where='WHERE o_orderkey % 3 <> 0')})")
def stream_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a reset in place: what came before, and its ids, are forgotten."""
    home = scratch_path(spark, "uploads")
    documents = _documents(spark, sf_dir)
    for step, part in enumerate((F.col("order") % 2 == 0, F.col("order") % 3 != 0)):
        documents.filter(part).select("value").write.mode("append").text(f"{home}/inbox")
        if step:
            uploads.reset_in_place(spark, f"{home}/ledger")
        uploads.apply_uploads(uploads.read_uploads(spark, f"{home}/inbox"), f"{home}/ledger", f"{home}/checkpoint").awaitTermination()
    return _tables(uploads.stored_tables(ledger.read(spark, f"{home}/ledger")))


@query(_MONTHLY_SQL + "SELECT * FROM m")
def registrar_report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registrar rows of all months by way of files whose names hold commas, quotes and line breaks, cells in either order."""
    home = scratch_path(spark, "reports")
    rows = monthly(spark, sf_dir).withColumn("net_adds", F.format_number("net_adds", 0)).repartition("report_month")
    name = F.concat(F.lit('Registrar "No. '), F.col("iana_id").cast("string"), F.lit('",\nInc.'))
    fields = {"iana_id": "IANA-ID", "tld": "TLD", "net_adds": "Net Adds", "renewals": "Renewals", "transfers": "Transfers", "deletes": "Deletes", "domains_under_mgmt": "DUM"}
    cells = [F.col(f).alias(h) for f, h in fields.items()]
    month = F.substring("report_month", 6, 2).cast("int") % 2
    for odd, columns in enumerate(([name.alias("Registrar\nName"), *cells], [*cells[::-1], name.alias("Notes")])):
        writer = rows.filter(month == odd).select("report_month", *columns).write.mode("append").partitionBy("report_month")
        writer.option("header", True).option("escape", '"').csv(home)
    return read_registrar_reports(spark, f"{home}/*", month_pattern=r"report_month=(\d{4}-\d{2})").drop("source_url")
