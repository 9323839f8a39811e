"""The registered queries of this subpackage, over the provided tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chunks, decontaminate, html_text, jaccard, merkle, mixing, pii, prefix_trie, quality, token_counts, toxicity, warc
from .stored import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that its rows have to equal."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids and back: how many, and digests of the ids and of the bytes they stand for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.tokenize(docs, VOCABULARY, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and the trees' verdict on every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.assess(docs, trees).select("doc_id", *[F.col("_stats")[name].alias(name) for name in base], "base_failed", "kept", "quality_score")


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels are learnt only where the remainder of the id's checksum is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), toxicity.score(docs, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


_WORDS7 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    f"""WITH d AS (SELECT doc_id, {_WORDS7} AS w FROM documents),
    i AS (SELECT item_id, {_WORDS7} AS w FROM benchmark),
    g AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS span
          FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 11, 2))) AS k) WHERE len(w) > 0),
    m AS (SELECT DISTINCT m FROM g),
    p AS (SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS span FROM d, m, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS k) WHERE len(w) >= m),
    h AS (SELECT doc_id, k, m, item_id FROM p JOIN g USING (m, span)),
    c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM h) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of the benchmark, and from which items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",").cast("binary")
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


@query()
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and group of every document, at 80 % of shared five-word shingles."""
    return jaccard.groups(table(spark, sf_dir, "documents"))


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths of all documents, with suffix sums and totals truncated at each length."""
    docs = table(spark, sf_dir, "documents").select("text")
    tokenizer = bpe.Tokenizer(docs, VOCABULARY, public_tokenizers.PATTERN)
    # a row per distinct length; stored, as the sums read it twice and texts are encoded once
    lengths = stored(token_counts.histogram(docs, tokenizer.count(F.col("text"))), "token-lengths")
    return token_counts.suffix_sums(lengths)


@query()
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that other documents have too, and where each was first."""
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


@query()
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal numbers, dates, addresses and secrets, and how many there were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return pii.pseudonymised(docs, spark.conf.get("spark.zonetide.pii.key", "a key for trials"), replaced="n_replaced")


@query()
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", html_text.main_text(pages, F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def captures(pages: DataFrame) -> DataFrame:
    """Two records of each page: its fetch, and a later revisit that names the validators of this fetch.

    Later fetches of the same canonical URL may come in between, and then the revisit disagrees with the latest one."""
    size = F.length(F.coalesce("html", F.lit("")))
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    at = F.col("page_id") * 10
    dated = F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))
    tag = F.when(size % 3 > 0, F.concat(F.lit('"'), F.substring(digest, 1, 8), F.lit('"')))
    common = {"etag": tag, "last_modified": F.when(size % 5 > 0, dated), "digest": digest}
    fetched = pages.select(
        F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("record_id"), "url", at.alias("captured_at"), F.lit("response").alias("kind"),
        F.when(size % 7 == 0, 404).otherwise(200).alias("status"), *[v.alias(k) for k, v in common.items()],
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size.cast("string"), F.lit("date"), at.cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    revisit_at = at + 10 * (size % 50) + 5
    revisited = pages.select(
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("record_id"), "url", revisit_at.alias("captured_at"), F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"), *[v.alias(k) for k, v in common.items()],
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), revisit_at.cast("string"), F.lit("set-cookie"), F.lit("x"), F.lit("vary"), F.lit("accept")).alias("headers"),
    )
    return fetched.union(revisited)


@query(
    r"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, length(coalesce(html, '')) AS size, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
    q AS (SELECT *, md5(h) AS digest, list_sort([x FOR x IN string_split(regexp_extract(rest, '\?(.*)$', 1), '&') IF x <> '']) AS args,
        regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') AS host,
        regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path FROM p),
    c AS (SELECT page_id, host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical, size, digest, page_id * 10 AS taken,
        CASE WHEN size % 3 > 0 THEN '"' || substr(digest, 1, 8) || '"' END AS etag, CASE WHEN size % 5 > 0 THEN 'day ' || (page_id % 1000) END AS modified FROM q),
    f AS (SELECT * FROM c WHERE size % 7 <> 0),
    r AS (SELECT *, taken + 10 * (size % 50) + 5 AS again FROM c),
    j AS (SELECT r.page_id, r.canonical, r.again, f.page_id AS hit, f.size AS hit_size,
        CASE WHEN f.page_id IS NULL THEN 'orphan' WHEN r.etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN r.etag = f.etag THEN 'resolved' ELSE 'mismatch' END
          WHEN r.modified IS NOT NULL AND f.modified IS NOT NULL THEN CASE WHEN r.modified = f.modified THEN 'resolved' ELSE 'mismatch' END
          WHEN r.digest = f.digest THEN 'resolved' ELSE 'mismatch' END AS outcome
        FROM r ASOF LEFT JOIN f ON r.canonical = f.canonical AND r.again > f.taken)
    SELECT 'r' || page_id AS record_id, canonical, again AS captured_at, 'f' || hit AS response_id, outcome,
      CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || hit_size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || again || chr(10) || 'vary: accept'
        ELSE 'content-length: 0' || chr(10) || 'date: ' || again || chr(10) || 'set-cookie: x' || chr(10) || 'vary: accept' END AS headers FROM j"""
)
def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of a page, the response it stands for, and the merged headers."""
    found = warc.resolve(captures(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical", "captured_at", "response_id", "outcome", warc.header_lines(F.col("headers")).alias("headers"))


# CRC-32 of the decimal text of {0}: a table of 256 remainders, then a step for each character
_CRC_TABLE = "crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl)"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    texts = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in texts) + ")"


def _levels_sql(name: str, anchor: str) -> str:
    """Levels of the trees whose leaves are (tree, k, pos, digest, n), and the climb from its leaves (id, tree, k, pos, n, folded, proof)."""
    return f"""{name}(tree, k, pos, digest, n) AS ({anchor} UNION ALL
      SELECT tree, k + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, k, pos // 2, n)"""


def _climb_sql(name: str, levels: str, anchor: str) -> str:
    return f"""{name}(id, tree, k, pos, n, folded, proof) AS ({anchor} UNION ALL
      SELECT id, c.tree, c.k + 1, c.pos // 2, (c.n + 1) // 2, sha256(CASE WHEN c.pos & 1 = 1 THEN digest || folded ELSE folded || coalesce(digest, '') END), proof || coalesce(digest, '')
      FROM {name} c LEFT JOIN {levels} s ON s.tree IS NOT DISTINCT FROM c.tree AND s.k = c.k AND s.pos = xor(c.pos, 1) WHERE c.n > 1)"""


@query(
    f"""WITH RECURSIVE {_CRC_TABLE},
    d AS (SELECT row_number() OVER () AS id, doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {_CRC.format("doc_id")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS other FROM documents, crc),
    l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
    {_levels_sql("lv", "SELECT lang, 0, pos, leaf, n FROM l")},
    s AS (SELECT tree AS lang, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
    {_levels_sql("top", "SELECT 0, 0, pos, subroot, n FROM s")},
    {_climb_sql("low", "lv", "SELECT id, lang, 0, pos, n, coalesce(other, leaf), '' FROM l")},
    {_climb_sql("high", "top", "SELECT low.id, 0, 0, s.pos, s.n, low.folded, low.proof FROM low JOIN s ON s.lang IS NOT DISTINCT FROM low.tree WHERE low.n = 1")}
    SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
    FROM l JOIN high ON high.id = l.id AND high.n = 1 JOIN s ON s.lang IS NOT DISTINCT FROM l.lang, (SELECT digest FROM top WHERE n = 1) r"""
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document, and the root that it gives with some documents' n_chars tampered with."""
    docs = table(spark, sf_dir, "documents")
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.leaf_digest([F.col(v) + 1 if v == "n_chars" else F.col(v) for v in values])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)
    nodes = merkle.manifest(docs, values, "lang", "doc_id", tampered)
    shown = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    proof = F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256")
    return nodes.select("doc_id", *shown, proof, F.lower(F.hex("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


@query()
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    docs = table(spark, sf_dir, "documents")
    mixed, draws = mixing.mix(docs, mixing.words_in(F.col("text")))
    return mixing.taken(mixed, draws).select("doc_id", "size", "source_size", "target", "taken")


@query(
    f"""WITH {_CRC_TABLE},
    t AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, substr(sha256(strlen(r) || ':' || r || x), 1, 32)) AS l
          FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
    h AS (SELECT conv_id, l, {_CRC.format("conv_id")} % 9 AS h FROM t, crc),
    c AS (SELECT h.conv_id, list_concat(coalesce(b.l[1:h], []), h.l[h + 1:]) AS l FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
    m AS (SELECT conv_id, len(l) AS n, unnest(range(0, len(l) + 1)) AS d, l FROM c),
    p AS (SELECT l[1:d] AS pre, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN n = d THEN conv_id END, ',' ORDER BY conv_id), '') AS ends FROM m GROUP BY 1),
    k AS (SELECT pre[1:d - 1] AS pre, count(*) AS n_children FROM p WHERE d > 0 GROUP BY 1),
    u AS (SELECT q.pre[1:a] AS pre, count(*) FILTER (k.pre IS NULL) AS n_leaves, sum(CASE WHEN d > 0 THEN (n_convs - 1) * strlen(q.pre[d].x) ELSE 0 END) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM p) q LEFT JOIN k ON k.pre = q.pre GROUP BY 1)
    SELECT p.conv_id, p.d AS depth, o.conv_id AS parent_conv_id, p.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(p.ends) AS ends_sha256
    FROM p JOIN u ON u.pre = p.pre LEFT JOIN k ON k.pre = p.pre LEFT JOIN p o ON p.d > 0 AND o.pre = p.pre[1:p.d - 1]"""
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt from the first turns of another one and its own later ones."""
    turns = prefix_trie.turn_rows(table(spark, sf_dir, "conversations"))
    nodes = prefix_trie.trie(*prefix_trie.rebuilt(turns))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.select(*nodes.columns[:-1], F.coalesce("ends", nothing).alias("ends_sha256"))
