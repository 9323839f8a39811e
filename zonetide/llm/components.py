"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .stored import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``links`` (a, b); roots are included.

    Alternates large-star and small-star steps until all links point at roots. Every step is an aggregate and joins, so
    a node with very many links is no group in one task; each round is stored, so lost executors cost one round.
    Null ends, self links and repeated links add nothing; without links there are no rows.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()
    pairs = stored(pairs, "links")
    while True:
        both = pairs.union(pairs.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        low = both.groupBy("child").agg(F.least(F.min("parent"), F.first("child")).alias("low"))
        large = both.filter("parent > child").join(low, "child").select(F.col("parent").alias("child"), F.col("low").alias("parent"))
        large = large.union(low.filter("low < child")).filter("child <> parent").distinct()
        low = large.groupBy("child").agg(F.min("parent").alias("low"))
        small = large.join(low, "child").select(F.col("parent").alias("child"), F.col("low").alias("parent")).union(low)
        pairs = stored(small.filter("child <> parent").distinct(), "links")
        roots = pairs.select(F.col("parent").alias("child")).distinct()
        if pairs.join(roots, "child", "left_semi").isEmpty():
            break
    found = pairs.select(F.col("child").alias("node"), F.col("parent").alias("root"))
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())
