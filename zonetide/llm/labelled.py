"""A bounded sample of labelled texts to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], where: Column | None = None, max_chars: int = 50_000) -> DataFrame:
    """(text, label) of at most ``per_class[k]`` documents of each class k, picked by a hash of their id.

    Only ids for which ``where`` holds and texts of at most ``max_chars`` characters serve for fitting, so what
    reaches the driver has a fixed bound. A null label or text is no label; of several labels of an id the largest counts.
    """
    labels = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        labels = labels.filter(where)
    labels = labels.groupBy("doc_id").agg(F.max("_label").alias("_label"))
    picked = None
    for value, n in sorted(per_class.items()):
        some = labels.filter(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.unionAll(some)
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # at most sum(per_class) rows of two numbers; of several texts of an id the smallest serves, so that rows are as few as ids
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    return found.select("doc_id", "text", F.col("_label").alias(label))
