"""A word list stored by position, so a batch from any cursor opens the folders it needs and no others.

Words are sorted once and written in sections of ``SECTION`` positions, a folder each; the number of words stands beside
them. A batch of pairs covers one run of positions, two if it wraps around the end, and reads the sections these fall into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixed import TRACKED_TLDS
from ..operators.candidates import word_batch
from ..operators.positions import with_position

SECTION = 100_000


def store_words(words: DataFrame, path: str, section: int = SECTION) -> None:
    """Store the distinct words of (word) in code-point order; a store that is there is replaced."""
    placed = with_position(words.select("word").distinct(), "word")
    rows = placed.select("pos", "word", F.expr(f"pos div {section}").alias("section"))
    # a section is one file, sorted by position
    rows.repartition("section").sortWithinPartitions("section", "pos").write.mode("overwrite").partitionBy("section").parquet(f"{path}/words")
    spark = words.sparkSession
    found = spark.read.schema("pos bigint, word string, section bigint").parquet(f"{path}/words")
    size = found.agg(F.count(F.lit(1)).alias("n")).withColumn("section_size", F.lit(section).cast("bigint"))
    size.write.mode("overwrite").parquet(f"{path}/size")


def sections_of(cursor: int, n: int, width: int, words: int, section: int) -> list[tuple[int, int]]:
    """Ranges of sections, ends included, that hold the words of the pairs ``cursor`` to ``cursor + n - 1``."""
    if not words or n <= 0:
        return []
    first, last = cursor // width, (cursor + n - 1) // width
    if last - first + 1 >= words:
        return [(0, (words - 1) // section)]
    low, high = first % words, last % words
    runs = [(low, high)] if low <= high else [(0, high), (low, words - 1)]
    return [(a // section, b // section) for a, b in runs]


def stored_words(spark: SparkSession, path: str, sections: list[tuple[int, int]]) -> DataFrame:
    """(pos, word) of some ranges of sections."""
    rows = spark.read.schema("pos bigint, word string, section bigint").parquet(f"{path}/words")
    inside = F.lit(False)
    for low, high in sections:
        inside = inside | F.col("section").between(low, high)
    return rows.filter(inside).select("pos", "word")


def batch(spark: SparkSession, path: str, cursor: int, n: int, tlds: list[str] = TRACKED_TLDS) -> DataFrame:
    """The next ``n`` (word, TLD) pairs from a pair cursor, wrapping at the end."""
    size = spark.read.parquet(f"{path}/size").head()
    words = stored_words(spark, path, sections_of(cursor, n, len(tlds), size.n, size.section_size))
    return word_batch(words, cursor, n, tlds, size.n)
