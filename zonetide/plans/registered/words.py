"""Words of documents as dictionary and probed labels; the language stands for the word class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.fixed import TRACKED_TLDS
from ...functions.text import SPACES
from ...operators import aggregates, candidates, dictionary
from ...operators.positions import with_position
from ...session import scratch_path, spread_small
from .. import word_index
from .registry import query, table

_POS = {"en": "noun", "fr": "verb", "de": "adj", "es": "adv"}
_TOKENS_SQL = r"""
  WITH t AS (SELECT CASE lang WHEN 'en' THEN 'noun' WHEN 'fr' THEN 'verb' WHEN 'de' THEN 'adj' WHEN 'es' THEN 'adv' END AS pos,
                    lower(unnest(regexp_split_to_array(text, '\s+'))) AS token FROM documents),
  w AS (SELECT DISTINCT pos, token AS word FROM t WHERE length(token) <= 10 AND regexp_matches(token, '^\p{L}+$')),
  i AS (SELECT word, arg_min(pos, list_position(['noun', 'verb', 'adj', 'adv'], pos)) AS pos FROM w GROUP BY word)
"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.element_at(F.create_map(*[F.lit(x) for pair in _POS.items() for x in pair]), F.col("lang"))
    documents = spread_small(table(spark, sf_dir, "documents").select("text", "lang"))
    return documents.select(pos.alias("pos"), F.explode(F.split("text", SPACES)).alias("word"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.clean_words(tokens(spark, sf_dir))


@query(_TOKENS_SQL + "SELECT pos, word FROM w")
def word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir)


@query(_TOKENS_SQL + "SELECT DISTINCT word FROM w ORDER BY word")
def word_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.word_union(words(spark, sf_dir)).orderBy("word")


@query(_TOKENS_SQL + "SELECT word, pos FROM i")
def pos_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.pos_index(words(spark, sf_dir))


@query(
    _TOKENS_SQL
    + """SELECT pos, CAST(count(*) AS BIGINT) AS words FROM w GROUP BY pos
    UNION ALL SELECT 'all', CAST(count(DISTINCT word) AS BIGINT) FROM w"""
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.word_counts(words(spark, sf_dir))


@query(
    _TOKENS_SQL
    + """SELECT i.pos, CAST(length(token) AS INTEGER) AS length, CAST(count(*) AS BIGINT) AS tracked_count,
      CAST(count(*) FILTER (length(token) % 3 = 0) AS BIGINT) AS unregistered_found,
      CAST(count(*) FILTER (length(token) % 3 <> 0 AND length(token) % 2 = 0) AS BIGINT) AS unused_found
    FROM t JOIN i ON t.token = i.word GROUP BY i.pos, length(token)"""
)
def word_pos_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("label")
    probed = tokens(spark, sf_dir).select(F.lower("word").alias("label"), F.lit("words").alias("mode"))
    probed = probed.withColumns(
        {
            "registered": size % 3 != 0,
            "usage_state": F.when(size % 2 == 0, "no_website").otherwise("active_site"),
        }
    )
    return aggregates.word_pos_stats(probed, dictionary.pos_index(words(spark, sf_dir)))


_TLD_ARRAY_SQL = "[" + ", ".join(f"'{t}'" for t in TRACKED_TLDS) + "]"


_PAIRS_SQL = (
    _TOKENS_SQL
    + f""", p AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS pos FROM (SELECT DISTINCT word FROM w)),
    n AS (SELECT count(*) AS c FROM p),
    r AS (SELECT unnest(range(1000, 21000)) AS pair)
    SELECT pair, word, {_TLD_ARRAY_SQL}[pair % 14 + 1] AS tld, word || '.' || {_TLD_ARRAY_SQL}[pair % 14 + 1] AS domain
    FROM r, n JOIN p ON p.pos = (r.pair // 14) % n.c"""
)


@query(_PAIRS_SQL)
def word_tld_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_position(dictionary.word_union(words(spark, sf_dir)), "word")
    return candidates.word_batch(placed, 1000, 20000)


@query(_PAIRS_SQL)
def stored_word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch from stored words: only the sections it falls into are read."""
    home = scratch_path(spark, "words")
    word_index.store_words(words(spark, sf_dir), home, section=1000)
    return word_index.batch(spark, home, 1000, 20000)
