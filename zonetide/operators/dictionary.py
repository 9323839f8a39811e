"""Word lists by part of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import MAX_LENGTH, PARTS_OF_SPEECH
from ..functions.text import as_word


def clean_words(lines: DataFrame, column: str = "word", max_length: int = MAX_LENGTH) -> DataFrame:
    """Distinct (pos, word): trimmed, lower-case, letters only, short enough."""
    words = lines.select("pos", as_word(column, max_length).alias("word"))
    return words.filter(F.col("word") != "").distinct()


def word_union(words: DataFrame) -> DataFrame:
    """Words of all lists, each once."""
    return words.select("word").distinct()


def pos_index(words: DataFrame) -> DataFrame:
    """The first list that has a word claims it: noun, verb, adj, adv.

    Lists are compared by number and named afterwards: a fixed-width minimum aggregates in a
    hash map, a text one would be sorted for.
    """
    lists = F.array(*[F.lit(p) for p in PARTS_OF_SPEECH])
    number = F.nullif(F.array_position(lists, F.col("pos")).cast("int"), F.lit(0))
    first = words.groupBy("word").agg(F.min(number).alias("_n"))
    return first.select("word", F.get(lists, F.col("_n") - 1).alias("pos"))


def word_counts(words: DataFrame) -> DataFrame:
    """Words per list, and of their union as ``all``.

    Each word is folded to one row of membership flags; the counts are sums over those.
    """
    member = [F.max((F.col("pos") == p).cast("int")).alias(p) for p in PARTS_OF_SPEECH]
    totals = words.groupBy("word").agg(*member).agg(
        F.count("*").alias("all"), *[F.sum(p).alias(p) for p in PARTS_OF_SPEECH]
    )
    names = [*PARTS_OF_SPEECH, "all"]
    return totals.unpivot([], names, "pos", "words").filter(F.col("words") > 0)
